"""Deeply nested JSON as flat tables, by Merkle identities of subtrees.

Each document is parsed once. Every object and array gets a hash over its canonical form, in which nested
containers stand as references to their own hashes, so equal subtrees anywhere in the data have one identity. ``nodes``
holds each distinct container once, as JSON of its own; ``occurrences`` keeps every place where one stands, with its
parent's identity, the path, the key and the ordinal.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from json.decoder import scanstring
from json.encoder import encode_basestring_ascii as quoted
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCCURRENCE = "doc_key string, side string, node_path string, parent_path string, relation string, key string, ordinal bigint, kind string, parent_kind string, again boolean, node_id string, parent_id string"
BATCH = 20_000
#: Key of a reference to a nested container. All nested containers are references, so no other object can stand there.
NODE = "$node"
_KEY = itemgetter(0)
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _clean(text: str) -> str:
    """Lone surrogates cannot be stored as UTF-8; they become U+FFFD."""
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def _constant(word: str) -> None:
    raise ValueError(f"{word} is not JSON")


class _Number(str):
    """A number as written."""


def _pairs(pairs: list[tuple[str, object]]) -> object:
    out = dict(pairs)
    return out if len(out) == len(pairs) else _Repeating(pairs)


class _Repeating(dict):
    """An object in which a key is repeated: the last value counts, and all of them stay in ``pairs``."""

    def __init__(self, pairs: list[tuple[str, object]]):
        super().__init__(pairs)
        self.pairs = pairs


def _parse(text: str) -> object:
    # numbers keep their spelling: 1 and 1.0 are different contents, and long integers do no harm
    try:
        return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_constant, object_pairs_hook=_pairs)
    except RecursionError:
        return parse_deep(text)


def parse_deep(text: str) -> object:
    """Strict JSON of any depth, without recursion; numbers keep their spelling. ValueError on anything else."""
    at, stack, keys = 0, [], []
    wants = "value"  # or "first" (value or ]), "key", "first key" (key or }), "more" (comma or end)
    root: object = None

    def put(value: object) -> None:
        nonlocal root
        if not stack:
            root = value
        elif isinstance(stack[-1], list) and keys[-1] is None:
            stack[-1].append(value)
        else:
            stack[-1].append((keys[-1], value))

    while True:
        at = _SPACE.match(text, at).end()
        c = text[at : at + 1]
        if wants in ("value", "first") and c in ("{", "["):
            stack.append([])
            keys.append("" if c == "{" else None)
            wants, at = ("first key" if c == "{" else "first"), at + 1
        elif (c == "]" and stack and keys[-1] is None and wants in ("first", "more")) or (c == "}" and stack and keys[-1] is not None and wants in ("first key", "more")):
            own, key = stack.pop(), keys.pop()
            put(own if key is None else _pairs(own))
            wants, at = "more", at + 1
        elif wants in ("key", "first key") and c == '"':
            keys[-1], at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("a colon is missing")
            wants, at = "value", at + 1
        elif wants in ("value", "first") and c == '"':
            value, at = scanstring(text, at + 1, True)
            put(value)
            wants = "more"
        elif wants in ("value", "first") and (m := _NUMBER.match(text, at)):
            put(_Number(m.group()))
            wants, at = "more", m.end()
        elif wants in ("value", "first") and (word := next((w for w in _WORDS if text.startswith(w, at)), None)):
            put(_WORDS[word])
            wants, at = "more", at + len(word)
        elif wants == "more" and stack and c == ",":
            wants, at = ("value" if keys[-1] is None else "key"), at + 1
        elif wants == "more" and not stack and at == len(text):
            return root
        else:
            raise ValueError(f"no JSON at {at}")


_WRITTEN = {True: "true", False: "false", None: "null"}


def _scalar(value: object) -> str:
    return str.__str__(value) if isinstance(value, _Number) else quoted(value) if isinstance(value, str) else _WRITTEN[value]


def _members(value: object) -> list[tuple]:
    if isinstance(value, list):
        return list(enumerate(value))
    return value.pairs if isinstance(value, _Repeating) else list(value.items())


def flatten_text(text: str) -> list[tuple]:
    """(path, parent_path, relation, key, ordinal, kind, parent_kind, again, node_id, parent_id, content) per container, root first.

    Of a repeated key every value has its row, in order; ``again`` marks rows whose path was there before. Raises ValueError on anything but
    strict JSON. Any depth is read.
    """
    root = _parse(text)
    if not isinstance(root, (dict, list)):
        return []
    order: list[list] = []
    stack: list[tuple] = [(root, -1, "", None, None, "", None)]
    while stack:
        value, up, path, key, ordinal, relation, place = stack.pop()
        at = len(order)
        order.append([value, up, path, key, ordinal, relation, place, {}])
        inner = [(i, k, v) for i, (k, v) in enumerate(_members(value)) if isinstance(v, (dict, list))]
        for i, k, v in reversed(inner):
            if isinstance(value, list):
                stack.append((v, at, f"{path}/{k}", None, k, relation, i))
            else:
                name = _clean(k)
                stack.append((v, at, f"{path}/{name}", name, None, name if isinstance(v, list) else relation, i))
    ids: list[str] = [""] * len(order)
    texts: list[str] = [""] * len(order)
    for i in range(len(order) - 1, -1, -1):
        value, up, *_, place, inner = order[i]
        parts = [(k, inner.get(j) or _scalar(v)) for j, (k, v) in enumerate(_members(value))]
        if isinstance(value, list):
            body = "[" + ",".join(t for _, t in parts) + "]"
        else:
            # keys in order; the values of a repeated key keep theirs
            body = "{" + ",".join(f"{quoted(k)}:{t}" for k, t in sorted(parts, key=_KEY)) + "}"
        ids[i] = blake2b(body.encode(), digest_size=16).hexdigest()
        texts[i] = body
        if up >= 0:
            order[up][-1][place] = f'{{"{NODE}":"{ids[i]}"}}'
    kinds = ["array" if isinstance(x[0], list) else "object" for x in order]
    repeats = any(isinstance(x[0], _Repeating) for x in order)
    seen: set[str] = set()
    out = []
    for i, (value, up, path, key, ordinal, relation, *_) in enumerate(order):
        above, kind, parent = (order[up][2], kinds[up], ids[up]) if up >= 0 else (None, None, None)
        out.append((path, above, relation, key, ordinal, kinds[i], kind, repeats and path in seen, ids[i], parent, texts[i]))
        if repeats:
            seen.add(path)
    return out


def _walk(with_content: bool):
    names = [x.split()[0] for x in OCCURRENCE.split(", ")] + ["content"] * with_content

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for key, side, text in zip(pdf["doc_key"], pdf["side"], pdf["text"]):
                try:
                    found = flatten_text(text)
                except ValueError:
                    rows.append((key, side, "", None, None, None, None, "rejected", None, False, "not_json", None, None)[: len(names)])
                    continue
                rows += [(key, side, *x)[: len(names)] for x in found]
                if len(rows) >= BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def documents_of(rows: DataFrame, key: str, text: str, side: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("doc_key"), F.lit(side).alias("side"), F.col(text).alias("text")).where(F.col("text").isNotNull())


def occurrences(documents: DataFrame, with_content: bool = False) -> DataFrame:
    """Bridge rows of every object and array of the documents (doc_key, side, text), the root included.

    relation is the key of the nearest array around the node, which names the flat table it belongs to. A null
    text has no nodes; a text that is a scalar has none either. A text that is no strict JSON gives one row of kind
    ``rejected`` whose node_id is the reason. Nesting may have any depth. Of a repeated key every value has its row.
    JSON inside strings stays text. Equal documents give equal rows under their own keys.
    """
    return documents.mapInPandas(_walk(with_content), OCCURRENCE + (", content string" if with_content else ""))


def nodes(bridge: DataFrame) -> DataFrame:
    """(node_id, kind, content, occurrences): each distinct subtree once; needs occurrences(with_content=True)."""
    return bridge.where(F.col("kind") != "rejected").groupBy("node_id").agg(F.first("kind").alias("kind"), F.first("content").alias("content"), F.count(F.lit(1)).alias("occurrences"))


def array_objects(bridge: DataFrame) -> DataFrame:
    """Occurrences of objects that are elements of an array; where a repeated key gives a path twice, both are there."""
    return bridge.where((F.col("kind") == "object") & (F.col("parent_kind") == "array"))


def relation_table(bridge: DataFrame, distinct: DataFrame, relation: str, fields: dict[str, str], single: bool = False) -> DataFrame:
    """One flat table: the objects of one relation with typed scalar fields, linked to their parent.

    The objects are the elements of arrays called ``relation``, or with ``single`` the objects under that key outside
    arrays. fields maps output columns, written ``name type``, to keys of the object; absent and nested values come out
    null, as do values not of the type. parent_path and parent_id name the container around the object, an array for an
    element. Equal objects are read once, in ``distinct``; every place they stand has its row.
    """
    columns = {}
    for spec, key in fields.items():
        name, _, kind = spec.partition(" ")
        if not re.fullmatch(r"\w+", name) or "'" in key:
            raise ValueError(f"not a column name or key: {spec}, {key}")
        columns[name] = _field(F.col("content"), key, kind or "string")
    if single:
        own = bridge.where((F.col("kind") == "object") & (F.col("key") == relation))
    else:
        own = array_objects(bridge).where(F.col("relation") == relation)
    parsed = distinct.where(F.col("kind") == "object").select("node_id", *[c.alias(n) for n, c in columns.items()])
    return own.select("doc_key", "side", "node_path", "parent_path", "ordinal", "node_id", "parent_id").join(parsed, "node_id").select("doc_key", "side", "node_path", "parent_path", "ordinal", "node_id", "parent_id", *columns)


def _field(content: Column, key: str, kind: str) -> Column:
    # content is JSON of one level; a nested value is an object with the one key NODE, a scalar has none
    nested = F.get_json_object(content, f"$['{key}']['{NODE}']")
    return F.when(nested.isNull(), F.get_json_object(content, f"$['{key}']").try_cast(kind))


def subtree_reuse(distinct: DataFrame) -> DataFrame:
    """Occurrences and distinct nodes per kind: what storing equal subtrees once saves."""
    return distinct.groupBy("kind").agg(F.sum("occurrences").cast("bigint").alias("occurrences"), F.count(F.lit(1)).alias("distinct_nodes"))
