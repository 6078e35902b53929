import json

import pytest

from weftline.llm import language, pairs


def chat(text, **more):
    return json.dumps({"choices": [{"index": 0, "message": {"role": "assistant", "content": text, **more}, "finish_reason": "stop"}]})


def ask(text):
    return json.dumps({"messages": [{"role": "system", "content": "x"}, {"role": "user", "content": text}]})


@pytest.mark.parametrize(("text", "want"), [("", True), (" \n", True), ("​", True), ("N/A", True), ("<empty>", True), ("```\n```", True), ("...", True), ("null", True), ("[]", True), ("7", False), ("No.", False)])
def test_empty(text, want):
    assert pairs.is_empty(text) == want


@pytest.mark.parametrize(
    ("answer", "want"),
    [("how does it work?", True), ("HOW DOES IT WORK", True), ("Q: How does it work?", True), ('"How  does it work?"', True), ("How does it work?\nHow does it work?", True), ("How does it work? It works.", False), ("How does it", False), ("", False)],
)
def test_copies(answer, want):
    assert pairs.copies("How does it work?", answer) == want
    assert not pairs.copies("", answer)


def test_language():
    texts = {"en": "A written plan helps when people share the work.", "de": "Ein Plan hilft, wenn mehrere Leute zusammenarbeiten.", "fr": "Un plan aide quand plusieurs personnes partagent le travail.", "es": "El aire húmedo lo retrasa todo, por eso conviene esperar.", "it": "Una buona luce evita quasi tutti gli errori.", "pt": "Uma boa luz evita quase todos os erros.", "nl": "Goed licht voorkomt bijna alle fouten."}
    assert {k: language.language(v) for k, v in texts.items()} == {k: k for k in texts}
    assert pairs.wrong_language(texts["en"], texts["nl"]) and not pairs.wrong_language("Translate into German: " + texts["en"], texts["de"])
    assert pairs.wrong_language("Translate into German: " + texts["en"], texts["it"]) and not pairs.wrong_language(texts["en"], "42")
    assert not pairs.wrong_language(texts["en"], "```python\ndef f():\n    return 1\n```")


def test_texts_of_every_shape():
    assert pairs.question_of({"prompt": "p"}) == "p" and pairs.question_of({"input": [{"role": "user", "content": [{"type": "input_text", "text": "i"}]}]}) == "i"
    assert pairs.question_of({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": None}]}) == ""
    assert pairs.answer_of({"choices": [{"index": 1, "text": "no"}, {"index": 0, "text": "yes"}]}) == ("yes", False)
    assert pairs.answer_of({"choices": [{"index": 0, "message": {"content": None, "refusal": "I can't"}}]}) == ("I can't", False)
    assert pairs.answer_of({"output": [{"type": "reasoning", "summary": []}, {"type": "message", "content": [{"type": "refusal", "refusal": "no"}]}]}) == ("no", False)
    assert pairs.answer_of({"choices": [{"index": 0, "message": {"content": "", "tool_calls": [{}]}}]}) == ("", True)
    assert pairs.answer_of([]) == ("", False) and pairs.question_of(None) == ""


def test_frames(spark):
    topics = ["soil drainage", "wood drying", "map projection", "lens cleaning", "tide forecasting", "glass recycling"]
    sound = "Good lighting and a clean surface prevent nearly all early mistakes. A written plan helps when several people share the work."
    cases = {}
    for i, t in enumerate(topics):
        q = f"How does {t} work in a small workshop?"
        cases[f"refusal {i}"] = (ask(q), chat(f"I'm sorry, but I must decline to discuss {t}. I hope you understand."), "refusal")
        cases[f"sound {i}"] = (ask(q), chat(sound), None)
        cases[f"hard {i}"] = (ask(q), chat("I can't stress enough how much a careful start helps. " + sound), None)
        cases[f"list {i}"] = (ask(q), chat("- A written plan helps when several people share the work\n- Good lighting and a clean surface prevent nearly all early mistakes"), None)
    q = ask("How does wood drying work in a rented flat?")
    cases |= {
        "field": (q, chat(None, refusal="I'm sorry, but I must decline to discuss wood drying."), "refusal"),
        "answered after all": (q, chat("I must decline to discuss wood drying. " + sound), None),
        "empty": (q, chat(" "), "empty"), "tool": (q, chat(None, tool_calls=[{"id": "x"}]), None), "number": (q, chat("42"), None),
        "copy": (q, chat("Q: How does wood drying work in a rented flat?"), "answer_copies_question"),
        "language": (q, chat("Goed licht en een schone tafel voorkomen bijna alle fouten."), "other_language"),
        "word": (q, chat("Good lighting and a cle"), "truncated"), "comma": (q, chat(sound + " If the values drift,"), "truncated"),
        "item": (q, chat("- A written plan helps when several people share the work\n- Good lighting and a clean surf"), "truncated"),
        "code": (q, chat("```python\ndef f("), "truncated"), "long": (q, chat(sound * 3000), None),
    }
    asked = spark.createDataFrame([(k, p, 1) for k, (p, _, _) in cases.items()] + [("alone", q, 1), (None, q, 1), ("null", None, 1), ("bad", "{", 1), ("field", q, 1)], "request_id string, params string, defect int")
    got = spark.createDataFrame([(k, r, 1) for k, (_, r, _) in cases.items()] + [("orphan", chat(""), 1), (None, chat(""), 1), ("null", chat(""), 1), ("bad", chat(""), 1)], "request_id string, response string, prompt_id int")
    found = pairs.find(asked, got).collect()
    assert len(found) == len({x.request_id for x in found})
    assert {x.request_id: x.defect for x in found} == {k: d for k, (_, _, d) in cases.items() if d}


def test_refusals_that_stand_alone_and_answers_that_only_sound_like_them(spark):
    q = "How does {} work?"
    cases = {
        "alone": ("soil drainage", "I'd rather not get into that topic.", "refusal"), "french": ("wood drying", "Je ne répondrai pas à cette demande.", None),
        "single": ("roof repair", "I can't provide a single number; it ranges between 4 and 6 litres.", None), "notice": ("lens cleaning", "I cannot help but notice that the soil drains better.", None),
        "then": ("seed storage", "I can't discuss seed storage. Keep the jars dry and cool, and turn them every other week.", None),
    }
    asked = spark.createDataFrame([(k, ask(q.format(t))) for k, (t, _, _) in cases.items()], "request_id string, params string")
    got = spark.createDataFrame([(k, chat(a)) for k, (_, a, _) in cases.items()], "request_id string, response string")
    found = {x.request_id: x.defect for x in pairs.find(asked, got).collect()}
    assert found.pop("french") in ("refusal", "other_language")
    assert found == {k: d for k, (_, _, d) in cases.items() if d}


def test_related_prompts_count_once():
    a, b, c = (pairs._marks(t) for t in ("How does soil drainage work in a small garden?", "how does soil drainage work in a small GARDEN", "Qué errores son frecuentes"))
    assert a == b and len(set(a) & set(c)) == 0


def test_deep_json_is_a_pair_like_any_other(spark):
    deep = '{"x":' + "[" * 5000 + "]" * 5000 + ',"choices":[{"index":0,"message":{"content":""}}]}'
    asked = spark.createDataFrame([("a", ask("Why?"))], "request_id string, params string")
    got = spark.createDataFrame([("a", deep)], "request_id string, response string")
    assert [tuple(x) for x in pairs.find(asked, got).collect()] == [("a", "empty")]


def test_empty_tables(spark):
    asked = spark.createDataFrame([], "request_id string, params string")
    got = spark.createDataFrame([], "request_id string, response string")
    assert pairs.find(asked, got).count() == 0


def test_copies_of_an_answer_do_not_change_its_defect(spark):
    for copies in (1, 4):
        answers = [chat("Fill it up to the upper level.")] + [chat("- Drain the tank\n- check the water level")] * copies
        answers += [chat("Change the water daily."), chat("Keep the water cool."), chat("Wash it with water.")] + [chat("- Drain the tank slowly.\n- look at the water")] * copies
        rows = [(f"r{i}", ask(f"What about pump number {i}?"), a) for i, a in enumerate(answers)]
        found = pairs.find(spark.createDataFrame([x[:2] for x in rows], "request_id string, params string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "request_id string, response string"))
        want = {(k, "truncated") for k, _, a in rows if a == answers[-1]}
        assert {(x.request_id, x.defect) for x in found.collect()} == want
