import random

import numpy as np
import pytest

from weftline.llm import mixing

WORDS = {"a": "apple orchard fruit", "b": "bolt engine steel", "c": "cloud rain wind"}


def corpus(spark, sizes):
    r = random.Random(6)
    rows = [(i, s, " ".join(r.choice(WORDS[s].split()) for _ in range(8)), r.randint(5, 60), "x") for i, s in enumerate([s for s, n in sizes.items() for _ in range(n)])]
    rows += [(-1, None, "apple", 9, "x"), (-2, "unlisted", "apple", 9, "x"), (-3, "a", None, 0, "x"), (-3, "a", None, None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens bigint, rate string")


TARGETS = "source string, target_share double, max_repeats int"


def test_shares_and_caps(spark):
    docs = corpus(spark, {"a": 600, "b": 300, "c": 40})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), (None, 0.1, 1)], TARGETS)
    mixed = mixing.mix(docs, targets)
    got = {x.source: x for x in mixing.shares(mixed, targets).collect()}
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)):
        assert got[s].share == pytest.approx(share, rel=0.005) and got[s].most_copies <= cap
    rows = mixed.collect()
    assert {x.source for x in rows} == {"a", "b", "c"} and all(0 <= x.rate <= 3 for x in rows)
    assert mixing.expand(mixed).count() == sum(x.copies for x in rows)
    # the smallest source is used up: the mixture is as large as the caps allow
    assert got["c"].tokens == 3 * got["c"].tokens_available
    assert len(rows) == 942 and len({(x.doc_id, x.tokens) for x in rows}) >= 941


def test_missing_sources_and_empty_tables(spark):
    docs = corpus(spark, {"a": 200, "b": 200})
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.25, 1), ("zz", 0.5, 4)], TARGETS)
    got = {x.source: x for x in mixing.shares(mixing.mix(docs, targets), targets).collect()}
    assert got["zz"].share == 0 and got["a"].share == pytest.approx(0.5, abs=0.02)
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    with pytest.raises(ValueError, match="twice"):
        mixing.read_targets(spark.createDataFrame([("a", 0.5, 1), ("a", 0.4, 1)], TARGETS))


def test_classifier_on_held_out_texts():
    r = random.Random(8)
    text = lambda s: " ".join(r.choice(WORDS[s].split()) for _ in range(6))
    sample = [(s, mixing._features(text(s))) for s in "abc" * 60]
    weights = mixing.train(sample, ["a", "b", "c"])
    right = sum("abc"[int(np.argmax(mixing._posterior(weights, text(s))))] == s for s in "abc" * 40)
    assert right >= 110


def test_memberships_are_soft_and_blind_to_the_source(spark):
    r = random.Random(4)
    words = [*WORDS["a"].split(), *WORDS["b"].split()]
    rows = [(i, "ab"[i % 2], " ".join(r.choice(words) for _ in range(8)), 10) for i in range(400)]
    rows += [(1000, "a", "bolt engine", 10), (1001, "b", "bolt engine", 10)]
    members = mixing.memberships(spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens bigint"), ["a", "b"], "doc_id", "text", "tokens")
    p = {x.k: mixing._memberships([x.p])[0] for x in members.collect()}
    assert np.array_equal(p["1000"], p["1001"]) and np.mean([v.max() for v in p.values()]) < 0.8


def test_gradient_steps_reach_the_targets(spark):
    docs = corpus(spark, {"a": 400, "b": 400, "c": 400})
    names = ["a", "b", "c"]
    members = mixing.memberships(docs, names, "doc_id", "text", "tokens")
    targets = [mixing.Target("a", 0.6, 1), mixing.Target("b", 0.3, 1), mixing.Target("c", 0.1, 1)]
    plan = mixing.solve(members.select("source", "p", "n"), targets)
    rows = members.collect()
    p, at = mixing._memberships([x.p for x in rows]), np.array([names.index(x.source) for x in rows])
    rates = mixing._rates(p, at, plan.caps[at], plan.start, plan.history)
    n = np.array([x.n for x in rows])
    assert rates.min() >= 0 and rates.max() <= 1
    for got in ((rates * n) @ p, np.bincount(at, rates * n)):
        assert np.abs(got - plan.wanted).max() < 0.05 * plan.wanted.sum()


def test_exchanges_close_the_gap():
    r = random.Random(2)
    for _ in range(200):
        lengths = np.array(sorted(r.sample(range(1, 400), 25)))
        more, fewer = np.array([r.randint(0, 2) for _ in lengths]), np.array([r.randint(0, 2) for _ in lengths])
        gap = r.randint(-900, 900)
        change, left = mixing.exchanges(lengths, more, fewer, gap)
        assert abs(left) <= abs(gap) and left == gap - sum(n * c for n, c in change.items())
        for n, c in change.items():
            i = int(np.searchsorted(lengths, n))
            assert c <= more[i] and -c <= fewer[i]
    assert mixing.exchanges(np.array([5, 8]), np.array([1, 1]), np.array([1, 1]), 3)[1] == 0
    assert mixing.exchanges(np.array([5]), np.array([0]), np.array([0]), 3) == ({}, 3)


def test_sample_does_not_depend_on_the_row_order(spark):
    sources = ["a", "b", "c", "d"]
    rows = [(i, sources[i // 200], f"text w{i} x{i * 7}", 5) for i in range(800)] + [(i, "d", "many", 5) for i in range(800, 3000)]
    taken = []
    for order in (rows, rows[::-1]):
        own = spark.createDataFrame(order, "doc_id bigint, source string, text string, n bigint")
        taken.append([(s, f.tolist()) for s, f in mixing.labelled_sample(own, sources, "doc_id", "text", 100)])
    assert taken[0] == taken[1] and [sum(s == x for s, _ in taken[0]) for x in sources] == [25] * 4
