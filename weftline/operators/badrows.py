"""Rows that fail to parse: valid rows typed, rejected rows with file, line and reason.

Records are assembled quote-aware from their physical lines, each is parsed with the strict csv reader inside its
partition, structural errors are caught there, and only then the typed field constructors run. The csv module lets
a quote inside an unquoted field pass even in strict mode; an exact check of the field grammar follows for that.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("request_id", "model", "job_id", "end_point", "request_body", "status")
#: The end points a request may name.
END_POINTS = ("/v1/responses", "/v1/chat/completions", "/v1/embeddings", "/v1/completions", "/v1/moderations")
JOB_ID = re.compile(r"batch_[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
GRAMMAR = re.compile(f"{_FIELD}(?:,{_FIELD})*+")
RESULT = "file_id string, line string, reason string, detail string, request_id string, model string, job_id string, end_point string, request_body string, status int"


class Invalid(ValueError):
    """A field constructor's refusal; the message names the field."""


def _refuse(word: str) -> None:
    raise ValueError(word)


def _deep_json_object(text: str) -> bool:
    """RFC 8259 check without recursion, for texts nested beyond the parser's depth."""
    scalar = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null', re.ASCII)
    space = re.compile(r"[ \t\n\r]*")
    string = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', re.ASCII)
    at, stack, state = space.match(text).end(), [], "value"
    if text[at : at + 1] != "{":
        return False
    while True:
        at = space.match(text, at).end()
        c = text[at : at + 1]
        if state in ("value", "first") and c in ("{", "["):
            stack.append(c)
            state, at = ("key or end" if c == "{" else "first"), at + 1
        elif state == "first" and c == "]" or state == "key or end" and c == "}" or state == "after" and stack and c == {"{": "}", "[": "]"}[stack[-1]]:
            stack.pop()
            state, at = "after", at + 1
        elif state in ("value", "first") and (m := scalar.match(text, at)):
            state, at = "after", m.end()
        elif state in ("key", "key or end") and (m := string.match(text, at)):
            at = space.match(text, m.end()).end()
            if text[at : at + 1] != ":":
                return False
            state, at = "value", at + 1
        elif state == "after" and stack and c == ",":
            state, at = ("key" if stack[-1] == "{" else "value"), at + 1
        else:
            return state == "after" and not stack and at == len(text)


def is_json_object(text: str) -> bool:
    """Whether the text is one JSON object in strict JSON; numbers may have any length, nesting any depth."""
    try:
        return isinstance(json.loads(text, parse_int=len, parse_float=len, parse_constant=_refuse), dict)
    except RecursionError:
        return _deep_json_object(text)
    except ValueError:
        return False


def _text(value: str) -> str:
    if not value:
        raise Invalid("empty")
    return value


def _matching(pattern: re.Pattern) -> Callable[[str], str]:
    def build(value: str) -> str:
        if not pattern.fullmatch(value):
            raise Invalid(value[:80])
        return value

    return build


def _one_of(allowed: tuple[str, ...]) -> Callable[[str], str]:
    def build(value: str) -> str:
        if value not in allowed:
            raise Invalid(value[:80])
        return value

    return build


def _body(value: str) -> str:
    if not is_json_object(value):
        raise Invalid("no JSON object")
    return value


def _status(value: str) -> int:
    if value not in ("0", "1"):
        raise Invalid(value[:80])
    return int(value)


CONSTRUCTORS: dict[str, Callable] = {"request_id": _text, "model": str, "job_id": _matching(JOB_ID), "end_point": _one_of(END_POINTS), "request_body": _body, "status": _status}


def assemble(lines: Iterable[str]) -> Iterator[str]:
    """Logical records out of physical lines (which keep their ends): a line break inside open quotes belongs to the record."""
    held: list[str] = []
    quotes = 0
    for line in lines:
        held.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            yield "".join(held)
            held, quotes = [], 0
    if held:
        yield "".join(held)


@dataclass(frozen=True)
class Parsed:
    reason: str | None
    detail: str | None
    values: tuple


NONE = (None,) * len(FIELDS)


def parse_record(text: str | None) -> Parsed:
    """One record: its typed values, or the first reason for which it is rejected."""
    text = text or ""
    if text.endswith("\r"):
        text = text[:-1]
    csv.field_size_limit(2**31 - 1)
    # the csv module takes any carriage returns at the end for the end of the record; here all but one are part of it
    ends = text[len(text.rstrip("\r")) :]
    try:
        *broken, last = text.rstrip("\r").split("\n")
        rows = list(csv.reader(assemble([x + "\n" for x in broken] + [last]), strict=True))
    except csv.Error as e:
        if GRAMMAR.fullmatch(text):
            # a bare carriage return or line break outside quotes: well quoted, but not one record
            return Parsed("column_count", str(e), NONE)
        return Parsed("quoting", str(e), NONE)
    if not GRAMMAR.fullmatch(text):
        return Parsed("quoting", "quote inside an unquoted field", NONE)
    if len(rows) != 1 or len(rows[0]) != len(FIELDS):
        return Parsed("column_count", f"{len(rows[0]) if rows else 0} fields", NONE)
    rows[0][-1] += ends
    values = []
    for name, value in zip(FIELDS, rows[0]):
        try:
            values.append(CONSTRUCTORS[name](value))
        except Invalid as e:
            return Parsed("invalid_value", f"{name}: {e}", NONE)
    return Parsed(None, None, tuple(values))


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, line, text in zip(pdf["file_id"], pdf["line"], pdf["raw_text"]):
            x = parse_record(text)
            rows.append((file_id, line, x.reason, x.detail, *x.values))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"status": "Int32"})


def parse_records(lines: DataFrame) -> DataFrame:
    """(file_id, line, reason, detail, the six typed fields) for every row of lines (file_id, line, raw_text).

    reason is null for a valid row, whose fields are then set; else it is the first of ``quoting``,
    ``column_count``, ``invalid_value`` and the fields are null. A null or empty record has one empty field and is
    rejected for its column_count. A line break outside quotes makes it more than one record: column_count too.
    File and line are passed through, null or repeated as they are. Texts of any length and JSON of any depth are
    read whole.
    """
    return lines.select(F.col("file_id").cast("string").alias("file_id"), F.col("line").cast("bigint").cast("string").alias("line"), "raw_text").mapInPandas(_parse_all, RESULT).withColumn("line", F.col("line").cast("bigint"))


def split_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows); both read the same parse, which a caller writing both should cut or cache first."""
    parsed = parse_records(lines)
    return parsed.where(F.col("reason").isNull()).drop("reason", "detail"), parsed.where(F.col("reason").isNotNull()).select("file_id", "line", "reason", "detail")
