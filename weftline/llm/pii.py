"""Personal information inside free text: found by a conditional random field, replaced by typed placeholders."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from json.decoder import scanstring

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import crf
from weftline.llm.pii_labels import labelled_table
from weftline.operators import nested

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
TOKEN = re.compile(r"[ \t\xa0]?(?:[^\W\d_]+|\d+|[^\w\s]|_)|\n")  # a blank before a token stays with it
BLANKS = " \t\xa0"
LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
NAMES_LIMIT = 100_000  # the name list is a fixed table of one feature's values; a list beyond this is refused rather than broadcast
FOUND = "row_id bigint, request_id string, pii_type string, pii_key string, start int, stop int"


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token with the blank before it, start without that blank, end)."""
    return [(t := m.group(), m.start() + (t[0] in BLANKS), m.end()) for m in TOKEN.finditer(text)]


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


class Describe:
    """Word-shape features of one token; names from a list are one feature more."""

    def __init__(self, given: frozenset[str], family: frozenset[str], words: frozenset[str] | None = None):
        self.given, self.family, self.words = given, family, words

    def __call__(self, token: str) -> list[str]:
        joint = "j" if token[0] not in BLANKS else ""  # nothing stands between this token and the one before
        token = token if joint else token[1:]
        low = token.lower()
        out = ["1", "1" + joint] if joint else ["1"]
        if token.isdigit():
            out += [f"d{min(len(token), 16)}", f"d{min(len(token), 16)}{joint}", "digit", f"d{min(len(token), 16)}:{token[0]}"]
            if token[0] == "0":
                out.append("d0")
        elif token[0].isalpha():
            kind = "X" if token.isupper() else "x" if token.islower() else "Xx" if token[1:].islower() else "xX"
            if len(token) == 1:
                kind += "1"
            elif len(token) == 2:
                kind += "2"
            out += ["shape:" + kind, "shape:" + kind + joint, f"len{min(len(token), 8)}:{kind[0]}"]
            if self.words is None or low in self.words:
                out.append("w:" + low)
                out.append("W:" + token)
            else:
                out += ["rare", "rare:" + kind]
            for k in (2, 3, 4):
                if len(low) > k:
                    out.append(f"s{k}:{low[-k:]}")
            folded = _fold(token)
            if folded in self.given:
                out.append("given")
                out.append("given:" + kind)
            if folded in self.family:
                out.append("family")
        else:
            out += ["p:" + token, "p:" + token + joint]
        return out


PUNCTUATION = "\n.,-()@+/:'_["  # each a class of its own; all other signs share one
CLASSES = 52


def classify(token: str) -> int:
    """The coarse shape class of a token, for the triples of neighbouring shapes."""
    joint = 16 if token[0] not in BLANKS else 0
    token = token if joint else token[1:]
    if token.isdigit():
        return joint + 20 + min(len(token), 7)
    if not token[0].isalpha():
        return 1 + PUNCTUATION.index(token) if token in PUNCTUATION else 18
    if token.isupper():
        return joint + (28 if len(token) == 1 else 29)
    if not token.islower():
        return joint + 30
    return joint + (31 if len(token) == 1 else 33 if len(token) <= 3 else 34)


def _tagged(pieces: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    text = "".join(p for p, _ in pieces)
    kinds = np.empty(len(text), dtype=object)
    at = 0
    begins = set()
    for p, kind in pieces:
        kinds[at : at + len(p)] = kind
        if kind:
            begins.add(at)
        at += len(p)
    words, tags = [], []
    for token, start, _ in tokens(text):
        kind = kinds[start]
        words.append(token)
        tags.append("O" if not kind else ("B-" if start in begins else "I-") + kind)
    return words, tags


@lru_cache(maxsize=4)
def trained(given: frozenset[str], family: frozenset[str], least: int = 4, fold: tuple[int, int] | None = None) -> tuple[crf.Model, Describe]:
    """The model over the labelled table; words seen fewer than ``least`` times are described by shape and ending only.

    It is fitted once per session's driver, and its weights are sent to the executors. fold leaves frames out, for tests.
    """
    pairs = [_tagged(t) for t in labelled_table(fold=fold)]
    counts: dict[str, int] = {}
    for words, _ in pairs:
        for w in words:
            low = w.lower().lstrip(BLANKS)
            counts[low] = counts.get(low, 0) + 1
    describe = Describe(given, family, frozenset(w for w, n in counts.items() if n >= least))
    return crf.train([w for w, _ in pairs], [t for _, t in pairs], describe, classify, CLASSES), describe


# no start within a run of word signs, no way back into one: linear in any text
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]++\s?(?:@|\[at\]|\(at\))\s?[a-z0-9-]+(?:(?:\.|\s?[\[(]dot[\])]\s?)[a-z0-9-]*[a-z][a-z0-9-]*)+", re.I)
EXTENSION = re.compile(r"[\s,;]*(?:\b|(?<=\d))(?:ext|extension|extensión|x|durchwahl|poste|apparat)\b.*$", re.I | re.S)


def _emails(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in EMAIL.finditer(text)]


def _checked(text: str, kind: str, start: int, stop: int, emails: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The exact check of one decoded span: what cannot be of its type is dropped, stray edges are cut.

    An email's edges are those of the address-like run it lies in, wherever these are.
    """
    if kind == "email":
        at = bisect_right(emails, (stop,)) - 1
        return emails[at] if at >= 0 and emails[at][1] > start else None
    span = text[start:stop]
    if kind == "phone":
        span = EXTENSION.sub("", span)
        stop = start + len(span)
        if start and text[start - 1] in "+(" and text[start].isdigit():
            start -= 1
        return (start, stop) if sum(c.isdigit() for c in span) >= 3 else None
    if kind == "id_number":
        return (start, stop) if any(c.isdigit() for c in span) else None
    if kind == "street_address":
        street, comma, last = span.rpartition(",")
        if comma and any(c.isdigit() for c in street) and last.strip()[:1].isupper() and not any(c.isdigit() for c in last):
            span, stop = street, start + len(street)  # the town does not belong to it
        return (start, stop) if any(c.isdigit() for c in span) and any(c.isalpha() for c in span) else None
    return (start, stop) if any(c.isupper() for c in span) and not any(c.isdigit() for c in span) else None


def spans(model: crf.Model, describe: Describe, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """(type, start, stop) of the personal information in each text, in order, without overlaps."""
    paths = crf.viterbi(model, [TOKEN.findall(t) for t in texts], describe, classify)
    out: list[list[tuple[str, int, int]]] = []
    for text, path in zip(texts, paths):
        if path is None:
            out.append([])
            continue
        found: list[list] = []
        now: list | None = None
        for (_, start, stop), label in zip(tokens(text), path):
            tag = model.labels[label]
            if tag == "O":
                now = None
            elif now is not None and tag[0] == "I" and now[0] == tag[2:]:
                now[2] = stop
            else:
                now = [tag[2:], start, stop]
                found.append(now)
        exact: list[tuple[str, int, int]] = []
        emails = _emails(text) if any(kind == "email" for kind, _, _ in found) else []
        for kind, start, stop in found:
            if kind == "person_name":
                start += len(text[start:stop]) - len(text[start:stop].lstrip(" ,;:-\n"))
                stop -= len(text[start:stop]) - len(text[start:stop].rstrip(" ,;:-\n"))
            if kind == "person_name" and exact and exact[-1][0] == "street_address" and re.fullmatch(r",\s*(?:\d{4,6}\s+)?", text[exact[-1][2] : start]):
                continue  # the town after a street
            if (e := _checked(text, kind, start, stop, emails)) and (not exact or e[0] >= exact[-1][2]):
                exact.append((kind, *e))
        out.append(exact)
    return out


def key_of(value: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(c for c in value.lower() if c.isalnum())


def literals(body: str) -> list[tuple[int, int, str]]:
    """(start, stop, decoded text) of the strings in a JSON body; of any other body the whole as one text."""
    try:
        json.loads(body, parse_int=len)
    except RecursionError:
        try:
            nested.parse_deep(body)
        except ValueError:
            return [(0, len(body), body)]
    except ValueError:
        return [(0, len(body), body)]
    return [(m.start(), m.end(), scanstring(body, m.start() + 1, False)[0]) for m in LITERAL.finditer(body)]


def raw_offsets(literal: str) -> list[int]:
    """For each character of the decoded JSON string, where it starts in the raw literal; one more for the end."""
    out, at = [], 1
    while at < len(literal) - 1:
        out.append(at)
        if literal[at] != "\\":
            at += 1
        elif literal[at + 1] != "u":
            at += 2
        else:
            at += 12 if re.match(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", literal[at : at + 12]) else 6
    return [*out, at]


def masked(body: str, found: list[tuple[int, int, str, list[tuple[str, int, int]]]]) -> str:
    """The body with [TYPE] in place of every span; all else stays as it was, escapes and spacing included."""
    out, at = [], 0
    for start, stop, text, own in found:
        literal = body[start:stop]
        quoted = len(literal) != len(text) or literal != text
        offsets = raw_offsets(literal) if quoted else None
        for kind, a, b in own:
            x, y = (offsets[a], offsets[b]) if offsets else (a, b)
            out += [body[at : start + x], f"[{kind.upper()}]"]
            at = start + y
    return "".join(out) + body[at:]


def _decode(model: crf.Model, describe: Describe, bodies: list[str | None]) -> list[list[tuple[int, int, str, list]]]:
    """Per body its literals with spans; equal texts of a batch are decoded once."""
    pieces = [[] if b is None else literals(b) for b in bodies]
    texts = list({t: None for p in pieces for _, _, t in p})
    known = dict(zip(texts, spans(model, describe, texts)))
    return [[(a, b, t, known[t]) for a, b, t in p if known.get(t)] for p in pieces]


def name_sets(names: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """The folded given and family names of the list; it is a fixed table, and a list over NAMES_LIMIT is refused."""
    rows = names.select("name", "kind").where(F.col("name").isNotNull()).limit(NAMES_LIMIT + 1).collect()
    if len(rows) > NAMES_LIMIT:
        raise ValueError(f"the name list has more than {NAMES_LIMIT} rows")
    pick = lambda kind: frozenset(_fold(r["name"]) for r in rows if r["kind"] == kind)
    return pick("given"), pick("family")


def _broadcast(spark: SparkSession, names: DataFrame):
    return spark.sparkContext.broadcast(trained(*name_sets(names)))


def find(rows: DataFrame, names: DataFrame, key: str = "request_id", text: str = "request_body") -> DataFrame:
    """(key, pii_type, pii_key) once per distinct value in the texts.

    All string values of a JSON body are read after decoding, any other body as it is, whole. Null and empty
    bodies hold nothing; a null key is kept as null. A value whose key would be empty is left out. Equal rows give
    their cases once. Other columns are not read.
    """
    model = _broadcast(rows.sparkSession, names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf_model, describe = model.value
        for pdf in batches:
            out = set()
            for owner, body in zip(pdf["k"], _decode(crf_model, describe, list(pdf["t"]))):
                for _, _, decoded, own in body:
                    for kind, a, b in own:
                        if value := key_of(decoded[a:b]):
                            out.add((owner, kind, value))
            yield pd.DataFrame(sorted(out, key=str), columns=["k", "pii_type", "pii_key"])

    found = rows.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInPandas(run, "k string, pii_type string, pii_key string")
    return found.withColumnRenamed("k", key).distinct()


def mask(rows: DataFrame, names: DataFrame, text: str = "request_body", into: str = "masked_body") -> DataFrame:
    """rows with a column of the masked text; null stays null, extra columns pass through."""
    model = _broadcast(rows.sparkSession, names)

    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        crf_model, describe = model.value
        values = [b if isinstance(b, str) else None for b in bodies]
        return pd.Series([b if b is None else masked(b, own) for b, own in zip(values, _decode(crf_model, describe, values))], dtype=object)

    return rows.withColumn(into, run(F.col(text)))
