import random

import numpy as np

from weftline.llm import spam

SPEECH = ["Where did you leave the lamp?", "Nobody goes to the market anymore.", "I told you, Mira, we meet at noon.", "Stay here.", "It was only a letter, my friend.", "You promised we would leave before the storm.", "- Where is Jonas?", "Not tonight. It's too late.", "(thunder)", "♪ Carry me over the water ♪", "Run!"]
RUBBISH = ["cheap shoes, best shoes online, shoes price, buy shoes, shoes", "https://shop.example/deals www.deals.test/p/1", "#shoes #fast_loan #garden #deals", "[SHOES] [black] [99918] [46% off]", "Shoes; XL; no 31516; stock 83", "shoes price buy shoes cheap shoes shoes review shoes", "Buy loan cheap loan: loan loan best loan."]


def srt(lines):
    return "﻿" + "".join(f"{i}\r\n00:00:0{i % 10},000 --> 00:00:0{i % 10},900\r\n{line}\r\n\r\n" for i, line in enumerate(lines, 1))


def test_text_lines():
    assert spam.text_lines(srt(["a", "7", "<i>b</i>"])) == ["a", "<i>b</i>"]
    assert spam.text_lines("WEBVTT\n\nNOTE x\n00:01.000 --> 00:02.000 align:start\nHallo\nâ™ª CafÃ© â™ª") == ["Hallo", "♪ Café ♪"]
    assert spam.text_lines("") == []


def test_features_point_to_spam():
    speech = np.array([spam.features(x) for x in SPEECH])
    rubbish = np.array([spam.features(x) for x in RUBBISH])
    assert (rubbish.max(1) > 1).all() and (np.maximum(speech, 0).sum(1) < rubbish.clip(0).sum(1).min() + 1).all()
    assert all(np.isfinite(spam.features(x)).all() for x in ("", "?", "a" * 100_000, "1 2 3"))


def test_frames(spark):
    r = random.Random(1)
    rows, want = [], set()
    for i in range(300):
        share = r.choice([0, 0, 0, 0, 0.2, 0.8, 1.0]) if i > 3 else 0
        n = r.randint(8, 40)
        k = round(n * share)
        if k * 2 > n:
            want.add(i)
        lines = [r.choice(RUBBISH) for _ in range(k)] + [r.choice(SPEECH) for _ in range(n - k)]
        r.shuffle(lines)
        rows.append((i, srt(lines), "en", 1))
    rows += [(1000, None, "en", 1), (1001, "", "en", 1), (None, srt(SPEECH), None, 1), (rows[-1][0], rows[-1][1], "en", 1), (1002, srt(SPEECH * 2000), "en", 1), (1003, srt(["https://a.example/x"] * 9), None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lines int")
    assert {x.doc_id for x in spam.find(df).collect()} == want | {1003}
    scored = {x.doc_id: x for x in spam.score(df).collect()}
    assert scored[1001].lines == 0 and 1000 not in scored and scored[1002].lines == len(SPEECH) * 2000
    assert spam.find(df.limit(0)).count() == 0


def test_copies_of_one_page_are_no_norm(spark):
    r = random.Random(4)
    rows = [(i, srt([r.choice(SPEECH) for _ in range(r.randint(8, 40))])) for i in range(200)]
    rows += [(200 + i, srt([r.choice(RUBBISH) for _ in range(20)])) for i in range(10)]
    # a third of all rows; other cue times and line ends make no other page
    copied = srt(["buy shoes, the best shoes online", "cheap shoes; shoes price", "#shoes #deals", "www.deals.test/p/1"] * 4)
    rows += [(1000 + i, copied if i % 2 else copied.replace("\r\n", "\n").replace(",900", ",800")) for i in range(105)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id for x in spam.find(df).collect()} == {i for i, _ in rows if i >= 200}


def test_links_are_hosts_of_any_name():
    hits = {"visit shop.neverseen/x": 1, "WWW.A.B and www . deals . test": 2, "Hello.World": 0, "10.50kg": 0, "v1.2.3": 0, "It is late.": 0, "foo.com.": 1}
    assert {t: len(spam.LINK.findall(t)) for t in hits} == hits
    for long in ("a" * 200_000, "ab." * 60_000, "<" * 100_000, "{\\" * 50_000):
        assert np.isfinite(spam.features(long)).all()
    assert spam.features("<" + "x" * 500 + ">Stay here.") == spam.features("Stay here.")
