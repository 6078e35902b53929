import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import nested

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(alphabet="abc/", max_size=3), x, max_size=4), max_leaves=20)


def brute(value, path="", in_array=False):
    if isinstance(value, dict):
        if in_array:
            yield path
        for k, v in value.items():
            yield from brute(v, f"{path}/{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute(v, f"{path}/{i}", True)


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_paths_of_array_objects(value):
    rows = nested.flatten_text(json.dumps(value))
    assert sorted(r[0] for r in rows if r[5] == "object" and r[6] == "array") == sorted(brute(value))


def test_equal_subtrees_share_an_identity():
    rows = {r[0]: r[8] for r in nested.flatten_text('{"a":[{"x":1,"y":[2]},{"y":[2],"x":1},{"x":"1","y":[2]}],"b":{"x":1,"y":[2]}}')}
    assert rows["/a/0"] == rows["/a/1"] == rows["/b"] != rows["/a/2"]
    assert rows["/a/0/y"] == rows["/a/2/y"]


def test_order_and_spelling_of_numbers_matter():
    ids = [nested.flatten_text(t)[0][8] for t in ("[1,2]", "[2,1]", "[1.0,2]")]
    assert len(set(ids)) == 3


@pytest.mark.parametrize("text", ["", "{", "NaN", '{"a":NaN}', "[1,]", "[1 2]", '{"a" 1}', "[01]", '{"a":1,}', "[}", '["\t"]', "1 2", "]"])
def test_not_json(text):
    with pytest.raises(ValueError):
        nested.flatten_text(text)
    with pytest.raises(ValueError):
        nested.parse_deep(text)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.sampled_from([None, 1]))
def test_both_parsers_agree(value, indent):
    text = json.dumps(value, indent=indent)
    assert nested.parse_deep(text) == nested._parse(text)
    assert json.dumps(nested.parse_deep('{"n":[-1.5e3,0],"w":[true,false,null]}')) == '{"n": ["-1.5e3", "0"], "w": [true, false, null]}'


def test_any_depth_and_repeated_keys():
    text = '{"a":' * 4000 + '[{"b":[{}]}]' + "}" * 4000
    rows = nested.flatten_text(text)
    assert [r[0] for r in rows if r[5] == "object" and r[6] == "array"] == ["/a" * 4000 + "/0", "/a" * 4000 + "/0/b/0"]
    twice = [(r[0], r[7]) for r in nested.flatten_text('{"a":[{"x":1}],"a":[{"x":2},{}]}')]
    assert twice == [("", False), ("/a", False), ("/a/0", False), ("/a", True), ("/a/0", True), ("/a/1", False)]
    assert len({r[8] for r in nested.flatten_text('[{"a":1,"a":2},{"a":2,"a":1},{"a":2}]')}) == 4


def test_frames(spark):
    deep = "[" * 3000 + "]" * 3000
    rows = [("a", '{"m":[{"role":"user","content":"hi"},{"role":"user","content":"hi"}]}', 1), ("b", None, 2), (None, '{"m":[{"role":"x"}]}', 3), ("c", "broken", 4), ("d", deep, 5), ("e", '"scalar"', 6), ("a", '{"m":[{"role":"user","content":"hi"}]}', 7), ("s", '{"\\ud800":[{}]}', 8), ("l", json.dumps({"m": [{"role": "w" * 300_000}]}), 9)]
    df = spark.createDataFrame(rows, "request_id string, text string, node_path int")
    docs = nested.documents_of(df, "request_id", "text", "params")
    bridge = nested.occurrences(docs, with_content=True)
    found = nested.array_objects(bridge).select("doc_key", "node_path").collect()
    assert sorted((x[0] or "", x[1]) for x in found) == [("", "/m/0"), ("a", "/m/0"), ("a", "/m/0"), ("a", "/m/1"), ("l", "/m/0"), ("s", "/�/0")]
    assert {(x.doc_key, x.node_id) for x in bridge.where("kind = 'rejected'").collect()} == {("c", "not_json")}
    assert bridge.where("doc_key = 'd'").count() == 3000
    distinct = nested.nodes(bridge)
    assert distinct.count() == distinct.select("node_id").distinct().count()
    assert distinct.agg(F.sum("occurrences")).first()[0] == bridge.where("kind <> 'rejected'").count()
    messages = nested.relation_table(bridge, distinct, "m", {"role": "role", "content": "content"}).where("doc_key = 'a'").collect()
    assert len(messages) == 3 and all(x.role == "user" and x.content == "hi" and x.parent_path == "/m" for x in messages)
    assert nested.occurrences(docs.limit(0)).count() == 0


def test_typed_fields(spark):
    # a text that looks like a reference stays a text; nested values and values of another type are null
    text = json.dumps({"m": [{"role": ',#0123456789abcdef0123456789abcdef', "n": "7", "f": {"name": "go"}}, {"role": '{"$node":"x"}', "n": "x", "f": 3}, {"role": {"$node": "x"}, "n": 5}]})
    docs = nested.documents_of(spark.createDataFrame([("a", text)], "id string, text string"), "id", "text", "params")
    bridge = nested.occurrences(docs, with_content=True)
    rows = nested.relation_table(bridge, nested.nodes(bridge), "m", {"role": "role", "n bigint": "n", "f": "f"}).orderBy("ordinal").collect()
    assert [(x.role, x.n, x.f) for x in rows] == [(",#0123456789abcdef0123456789abcdef", 7, None), ('{"$node":"x"}', None, "3"), (None, 5, None)]
    alone = nested.relation_table(bridge, nested.nodes(bridge), "f", {"name": "name"}, single=True).collect()
    assert [(x.node_path, x.parent_path, x.name) for x in alone] == [("/m/0/f", "/m/0", "go")]
    with pytest.raises(ValueError):
        nested.relation_table(bridge, nested.nodes(bridge), "m", {"role": "a'b"})
