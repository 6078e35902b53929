import csv
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators import badrows

JOB = "batch_01234567-89ab-cdef-0123-456789abcdef"
GOOD = ["r1", "m", JOB, "/v1/responses", '{"a":1}', "0"]


def record(fields, quote=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, quoting=quote, lineterminator="").writerow(fields)
    return out.getvalue()


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (record(GOOD), None),
        (record(GOOD, csv.QUOTE_ALL), None),
        (record(GOOD) + "\r", None),
        (record(GOOD) + "\r\r", "invalid_value"),
        (record(["r", "", *GOOD[2:]]), None),
        (record([" ", *GOOD[1:]]), None),
        (record(["", *GOOD[1:]]), "invalid_value"),
        (record([*GOOD[:2], JOB.upper(), *GOOD[3:]]), "invalid_value"),
        (record([*GOOD[:2], JOB + "\n", *GOOD[3:]]), "invalid_value"),
        (record([*GOOD[:2], " " + JOB, *GOOD[3:]]), "invalid_value"),
        (record([*GOOD[:3], "/v1/other", *GOOD[4:]]), "invalid_value"),
        (record([*GOOD[:5], "2"]), "invalid_value"),
        (record([*GOOD[:5], "00"]), "invalid_value"),
        (record(GOOD[:5]), "column_count"),
        (record([*GOOD, ""]), "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        ('"open', "quoting"),
        (record(GOOD)[:-1] + '"0', "quoting"),
        ('a"b,' + record(GOOD[1:]), "quoting"),
        ('"a" ,' + record(GOOD[1:]), "quoting"),
        ('"a"b,' + record(GOOD[1:]), "quoting"),
        (record([*GOOD[:4], '{\n"a":\r\n[1,\t2]}', "1"]), None),
    ],
)
def test_reasons(text, reason):
    assert badrows.parse_record(text).reason == reason


@pytest.mark.parametrize("body", ["[]", "null", "1", '"x"', '{"a":NaN}', '{"a":1,}', "{'a':1}", '{"a":01}', '{"a":-Infinity}', "{} x", '{"a":"\n"}', "﻿{}", '{"a":"\\x"}', '{"a" 1}'])
def test_bodies_that_are_no_json_object(body):
    assert not badrows.is_json_object(body)
    if body[:1] == "{":
        assert not badrows._deep_json_object(body)


def test_long_and_deep_bodies():
    assert badrows.is_json_object('{"n":' + "7" * 10_000 + "}")
    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    assert badrows.is_json_object(deep) and not badrows.is_json_object(deep[:-1])


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=4), st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)))
def test_both_json_checks_agree(value):
    for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1)):
        assert badrows.is_json_object(text) and badrows._deep_json_object(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n\r x', max_size=6), min_size=1, max_size=8))
def test_round_trip_of_fields(fields):
    text = record(fields, csv.QUOTE_ALL)
    parsed = badrows.parse_record(text)
    assert parsed.reason == ("column_count" if len(fields) != 6 else "invalid_value")


def test_frames(spark):
    rows = [("f", 1, record(GOOD), 5), (None, None, record(GOOD), 6), ("f", 2, "x", 7), ("f", 2, "x", 7), ("f", 3, None, 8), ("f", 4, record([*GOOD[:4], json.dumps({"t": "w" * 500_000}), "1"]), 9)]
    df = spark.createDataFrame(rows, "file_id string, line bigint, raw_text string, reason int")
    valid, rejected = badrows.split_records(df)
    assert sorted((x.file_id or "", x.line or 0, x.status) for x in valid.collect()) == [("", 0, 0), ("f", 1, 0), ("f", 4, 1)]
    assert sorted((x.line, x.reason) for x in rejected.collect()) == [(2, "column_count"), (2, "column_count"), (3, "column_count")]
    assert badrows.parse_records(df.limit(0)).count() == 0
