import json
import pytest
from weftline.llm import crf, pii


@pytest.fixture(scope="module")
def model():
    return pii.trained(frozenset({"anna", "peter", "rose", "will"}), frozenset({"king"}))


def found(model, text):
    return [(k, text[a:b]) for k, a, b in pii.spans(*model, [text])[0]]


def test_viterbi_is_the_best_path(model):
    import itertools

    import numpy as np

    crf_model, describe = model
    small = crf.Model(crf_model.labels[:3], crf_model.features, crf_model.weights[:, :, :3], crf_model.triples[:, :3], crf_model.classes, crf_model.transition[:3, :3] * 3, crf_model.start[:3])
    for tokens in (["Tel", ".", " 07700", " 900", " 123"], ["Anna", " Marwick"], ["x"]):
        vocabulary, coded = crf._vocabulary([tokens])
        tables = crf._tables(small.weights, crf._matrix(vocabulary, describe, small.features, grow=False))
        ids, _ = crf._padded(coded)
        e = crf._emissions(tables, small.triples, ids, crf._triples(crf._kinds(vocabulary, pii.classify), small.classes, ids))[0]
        value = lambda p: small.start[p[0]] + sum(e[i, y] for i, y in enumerate(p)) + sum(small.transition[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=len(tokens)), key=value)
        got = crf.viterbi(small, [tokens], describe, pii.classify, plain=small.labels[0])[0]
        assert np.isclose(value(best), value(tuple(got) if got is not None else (0,) * len(tokens)), atol=1e-3)


def test_edges(model):
    assert found(model, "Call me on 303-555-0118 ext. 4 after six.") == [("phone", "303-555-0118")]
    assert found(model, "Please ask for Mrs Corwick, Anna at the desk.") == [("person_name", "Corwick, Anna")]
    assert found(model, "I live at 90 Marrowdale Ave, Apt 4C, Marosk.") == [("street_address", "90 Marrowdale Ave, Apt 4C")]
    assert found(model, "The Rose Plus kettle costs 28.52 euros. Order no. 9834-951 is still open.") == []
    # no edge depends on how far a value reaches, no length is left out
    long = "x" * 300 + "@" + "y" * 200 + ".example"
    assert found(model, f"Mail: {long}") == [("email", long)]
    assert pii.literals("ab") == [(0, 2, "ab")] and pii.spans(*model, ["", "a", "ab"]) == [[], [], []]
    deep = '{"a":' * 5000 + '"Mail: anna.wick@mail.example \\u00e9"' + "}" * 5000
    assert [t for _, _, t in pii.literals(deep)][-1] == "Mail: anna.wick@mail.example é"
    assert pii.key_of("+44 (0)1632 960-025") == "4401632960025"


def test_masking_leaves_the_rest_as_it_was(model):
    body = '{"model":"m", "messages": [{"role":"user","content":"Je m\'appelle \\u00c9mile Norwick.\\nT\\u00e9l. 01 99 00 88 43"}], "x": "\\ud83d\\ude00 Contact: anna.wick@mail.example"}'
    own = pii._decode(*model, [body])[0]
    masked = pii.masked(body, own)
    assert masked == body.replace("\\u00c9mile Norwick", "[PERSON_NAME]").replace("01 99 00 88 43", "[PHONE]").replace("anna.wick@mail.example", "[EMAIL]")
    assert json.loads(masked)["messages"][0]["content"] == "Je m'appelle [PERSON_NAME].\nTél. [PHONE]"
    plain = 'He said "call" Tel. 07700 900123'
    assert pii.masked(plain, pii._decode(*model, [plain])[0]) == 'He said "call" Tel. [PHONE]'


def test_frames(spark):
    names = spark.createDataFrame([(1, "Anna", "given"), (2, None, "given"), (3, "King", "family")], "name_id int, name string, kind string")
    text = "Please send the copy to anna.wick@mail.example before Friday."
    long = "The manual does not mention the blue lamp at all. " * 20_000 + text
    rows = [("a", json.dumps({"prompt": text}), 1), ("a", json.dumps({"prompt": text}), 1), ("b", text, 2), (None, text, 3), ("c", None, 4), ("d", "", 5), ("e", long, 6), ("f", '{"x":"\\ud800 ' + text + '"}', 7)]
    df = spark.createDataFrame(rows, "request_id string, request_body string, pii_type int")
    got = pii.find(df, names).collect()
    assert {x.request_id for x in got} == {"a", "b", None, "e", "f"} and all(tuple(x)[1:] == ("email", "annawickmailexample") for x in got) and len(got) == 5
    masked = {(x.request_id, x.pii_type): x.masked_body for x in pii.mask(df, names).collect()}
    assert masked["c", 4] is None and masked["d", 5] == "" and masked["b", 2] == "Please send the copy to [EMAIL] before Friday."
    assert len(masked["e", 6]) == len(long) - len("anna.wick@mail.example") + len("[EMAIL]")
    assert pii.find(df.limit(0), names).count() == 0 and pii.find(df, names.limit(0)).where("request_id = 'b'").count() == 1
