"""Lengths of texts in tokens of a public byte-level BPE vocabulary, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how this vocabulary cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(ranks: bytes):
    """A tokenizer from the bytes of a rank file."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(documents: DataFrame, text: str = "text", into: str = "tokens", *, tokenizer: str) -> DataFrame:
    """documents without their text, with its length in tokens; null counts 0. The vocabulary file at ``tokenizer`` (under 1 MB) is broadcast."""
    ranks = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    cache: dict = {}

    @F.pandas_udf("bigint")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "own" not in cache:
            cache["own"] = encoder(ranks.value)
        encode = cache["own"].encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return documents.withColumn(into, lengths(F.col(text))).drop(text)
