"""Mixing sources to target weights.

A classifier of whole texts, trained on a bounded labelled sample and never told a record's source, gives every document
a soft membership in the sources. Projected gradient steps then look for nonnegative rates, at most the source's
repeats, for which the expected tokens per domain and the tokens per labelled source both match the targets in the
least-squares sense. Documents of one source with the same quantised membership move alike, so the steps run over the
histogram of those cells, not over the documents. The rates become whole copies by a threshold per source, read off a
histogram of bins, and a few documents change places until each source's tokens are as close to its target as they get:
the exact check that the shares of the labelled sources are reached.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

BUCKETS = 4096
SAMPLE = 4_000  # labelled documents the classifier is trained on, at most; each brings at most BUCKETS numbers to the driver
MAX_SOURCES = 10_000
WORD = re.compile(r"[^\W\d_]{2,}|\d+[:.,]\d+|[^\w\s]")
LEVELS = 16  # steps a membership is rounded to
BINS = 1024  # bins between one copy and the next
ROUNDS = 12  # exchanges per source at the end, at most
MAX_LENGTH = 1_000_000  # documents beyond this many tokens do not change places at the end; one count per length goes to the driver


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def read_targets(targets: DataFrame) -> list[Target]:
    """The target table, a small fixed one: a table of over 10,000 sources is refused. Null or unusable rows are left out."""
    rows = targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").distinct().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES or len({r["source"] for r in rows}) < len(rows):
        raise ValueError("the target table has too many sources, or one of them twice")
    return sorted((Target(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in rows), key=lambda t: t.source)


def _features(text: str | None) -> np.ndarray:
    """Hashed presence of the words and signs of the whole text."""
    found = set(WORD.findall((text or "").lower()))
    return np.unique(np.array([xxhash.xxh32_intdigest(w) % BUCKETS for w in found] or [0], dtype=np.int64))


def train(sample: list[tuple[str, np.ndarray]], sources: list[str], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> np.ndarray:
    """Softmax regression by AdaGrad over the labelled sample: feature x source weights, the last row the bias."""
    number = {s: i for i, s in enumerate(sources)}
    k = len(sources)
    weights = np.zeros((BUCKETS + 1, k))
    squares = np.full_like(weights, 1e-2)
    data = [(np.append(np.asarray(f, dtype=np.int64), BUCKETS), number[s]) for s, f in sample if s in number]
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(data)):
            at, y = data[i]
            value = 1.0 / math.sqrt(len(at))
            z = value * weights[at].sum(0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            gradient = value * p[None, :] + decay * weights[at]
            squares[at] += gradient * gradient
            weights[at] -= rate * gradient / np.sqrt(squares[at])
    return weights.astype(np.float32)


def _posterior(weights: np.ndarray, text: str | None) -> np.ndarray:
    at = np.append(_features(text), BUCKETS)
    z = weights[at].sum(0) / math.sqrt(len(at))
    p = np.exp(z - z.max())
    return p / p.sum()


def _quantised(p: np.ndarray) -> bytes:
    q = np.floor(p * LEVELS + 0.5)
    q[p.argmax()] = max(q[p.argmax()], 1)
    return q.astype(np.uint8).tobytes()


def _memberships(cells: pd.Series) -> np.ndarray:
    q = np.stack([np.frombuffer(c, dtype=np.uint8) for c in cells]).astype(np.float64)
    return q / q.sum(1, keepdims=True)


def labelled_sample(own: DataFrame, sources: list[str], key: str, text: str, sample: int) -> list[tuple[str, np.ndarray]]:
    """(source, features) of the rows of least hash of each source, as many of each as fit into ``sample``.

    Partitioning and the order of rows play no part.
    """
    quota = max(1, sample // max(len(sources), 1))
    place = F.pmod(F.xxhash64(key, "source", F.lit(17)), F.lit(1 << 40))
    counts = {r["source"]: r["n"] for r in own.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    # with half as many again and sixteen more, fewer than the quota come through about never
    limits = F.create_map(*[x for s, n in counts.items() for x in (F.lit(s), F.lit(int(min(1.0, (1.5 * quota + 16) / n) * (1 << 40))))])
    drawn = own.select("source", F.col(text).alias("t"), place.alias("place")).where(F.col("place") < limits[F.col("source")])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"source": pdf["source"], "place": pdf["place"], "f": [_features(t).astype(np.int32) for t in pdf["t"]]})

    rows = drawn.mapInPandas(describe, "source string, place bigint, f array<int>").collect()
    out: list[tuple[str, np.ndarray]] = []
    for s in sources:
        mine = sorted((r["place"], tuple(r["f"])) for r in rows if r["source"] == s)
        out += [(s, np.array(f, dtype=np.int64)) for _, f in mine[:quota]]
    return out


def memberships(documents: DataFrame, sources: list[str], key: str, text: str, tokens: str, sample: int = SAMPLE) -> DataFrame:
    """(k, source, n, p): each listed document's length and its quantised posterior over the sources, from its text alone."""
    spark = documents.sparkSession
    own = documents.where(F.col("source").isin(sources))
    weights = spark.sparkContext.broadcast(train(labelled_sample(own, sources, key, text, sample), sources))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "source": pdf["source"], "n": pdf["n"], "p": [_quantised(_posterior(weights.value, t)) for t in pdf["t"]]})

    read = own.select(F.col(key).cast("string").alias("k"), "source", F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n"), F.col(text).alias("t"))
    return read.mapInPandas(run, "k string, source string, n bigint, p binary")


def _rates(p: np.ndarray, at: np.ndarray, caps: np.ndarray, start: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """The rates after the steps so far: each moves against the residuals of its domains and of its source, then into [0, cap]."""
    k = len(start)
    rates = np.minimum(start[at], caps)
    for residual in history:
        rates = np.clip(rates - p @ residual[:k] - residual[k:][at], 0.0, caps)
    return rates


@dataclass(frozen=True)
class Plan:
    """What a document's rate follows from: the steps, the start and the caps per source; and the wanted tokens."""

    history: list[np.ndarray]
    start: np.ndarray
    caps: np.ndarray
    wanted: np.ndarray


def solve(cells: DataFrame, targets: list[Target], size: float | None = None, steps: int = 25, close: float = 1e-4, pace: float = 0.5) -> Plan:
    """Projected gradient steps over cells (source, p, n), the histogram of sources and memberships.

    The mixture's size is ``size`` tokens, or the most that lets every source that occurs reach its share.
    """
    names = [t.source for t in targets]
    number = {s: i for i, s in enumerate(names)}
    k = len(names)
    caps, shares = np.array([float(t.repeats) for t in targets]), np.array([t.share for t in targets])
    have = np.zeros(k)
    for r in cells.groupBy("source").agg(F.sum("n").alias("n")).collect():
        have[number[r["source"]]] = r["n"]
    there = have > 0
    if not there.any():
        return Plan([], np.zeros(k), caps, np.zeros(k))
    most = float((caps[there] * have[there] / shares[there]).min())
    wanted = np.where(there, shares, 0) * min(size or most, most)
    start = np.where(there, wanted / np.maximum(have, 1e-9), 0.0)
    history: list[np.ndarray] = []

    def sums() -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got, whole = np.zeros(2 * k), np.zeros(2 * k)
            for pdf in batches:
                if len(pdf):
                    p, n = _memberships(pdf["p"]), pdf["n"].to_numpy(np.float64)
                    at = np.array([number[s] for s in pdf["source"]])
                    taken = _rates(p, at, caps[at], start, history) * n
                    got += np.concatenate([taken @ p, np.bincount(at, taken, k)])
                    whole += np.concatenate([n @ p, np.bincount(at, n, k)])
            yield pd.DataFrame({"i": range(2 * k), "got": got, "whole": whole})

        rows = cells.mapInPandas(run, "i int, got double, whole double").groupBy("i").agg(F.sum("got").alias("got"), F.sum("whole").alias("whole")).collect()
        got, whole = np.zeros(2 * k), np.ones(2 * k)
        for r in rows:
            got[r["i"]], whole[r["i"]] = r["got"], r["whole"]
        return got, whole

    goal, last = np.concatenate([wanted, wanted]), math.inf
    for _ in range(steps):
        got, whole = sums()
        off = float(np.square(got - goal).sum())
        # near the least squares the sum no longer falls
        if off <= (close * wanted.sum()) ** 2 or off > last * (1 - close):
            break
        last = off
        history.append(pace * (got - goal) / np.maximum(whole, 1e-9))
    return Plan(history, start, caps, wanted)


def _shifts(bins: np.ndarray, tokens: np.ndarray, cap: int, wanted: float) -> int:
    """The shift, in bins, with which whole copies come closest to the wanted tokens without exceeding them."""
    low, high = -int(bins.max(initial=0)) - 1, (cap + 1) * BINS

    def reached(shift: int) -> float:
        return float((np.clip((bins + shift) // BINS, 0, cap) * tokens).sum())

    while high - low > 1:  # the total grows with the shift
        mid = (low + high) // 2
        low, high = (mid, high) if reached(mid) <= wanted else (low, mid)
    return low


def exchanges(lengths: np.ndarray, more: np.ndarray, fewer: np.ndarray, gap: float, rounds: int = ROUNDS) -> tuple[dict[int, int], float]:
    """({length: copies to add or drop}, what gap is left): single changes and swaps that bring the gap down to nothing.

    more and fewer say of how many documents of a length one copy more, or one fewer, may be taken.
    """
    change: dict[int, int] = {}
    more, fewer = more.copy(), fewer.copy()
    for _ in range(rounds):
        adding, dropping = np.flatnonzero(more > 0), np.flatnonzero(fewer > 0)
        best: tuple[float, int | None, int | None] = (abs(gap), None, None)
        sizes = lengths[adding]
        for drops in (np.array([-1]), dropping):
            base = np.where(drops < 0, 0, lengths[drops]) if len(drops) else np.array([])
            for d, need in zip(drops, gap + base):
                if d >= 0 and abs(gap + lengths[d]) < best[0]:
                    best = (abs(gap + lengths[d]), None, int(d))
                if len(sizes):
                    at = int(np.searchsorted(sizes, need))
                    for j in (at - 1, at):
                        if 0 <= j < len(sizes) and adding[j] != d and abs(need - sizes[j]) < best[0]:
                            best = (abs(need - sizes[j]), int(adding[j]), int(d) if d >= 0 else None)
        if best[1] is None and best[2] is None:
            break
        _, add, drop = best
        if add is not None:
            gap -= lengths[add]
            more[add] -= 1
            change[int(lengths[add])] = change.get(int(lengths[add]), 0) + 1
        if drop is not None:
            gap += lengths[drop]
            fewer[drop] -= 1
            change[int(lengths[drop])] = change.get(int(lengths[drop]), 0) - 1
    return {n: c for n, c in change.items() if c}, gap


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", tokens: str = "tokens", size: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """(key, source, tokens, rate, copies): every document of a listed source with its number of copies, which may be 0.

    documents has key, source, text and length. Documents of null or unlisted sources are no part of a mixture. Listed
    sources that do not occur are left out and the others keep their proportions. Null texts and lengths count 0
    tokens. Repeated rows are taken for different documents. Empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    wanted_by = read_targets(targets)
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, source string, tokens bigint, rate double, copies int"
    if not wanted_by:
        return spark.createDataFrame([], schema)
    names = [t.source for t in wanted_by]
    number = {s: i for i, s in enumerate(names)}
    members = cut(memberships(documents, names, key, text, tokens, sample))
    cells = cut(members.groupBy("source", "p").agg(F.sum("n").alias("n")))
    plan = solve(cells, wanted_by, size)
    # the same rate for a whole cell, and a draw per row to round it by
    draw = F.pmod(F.xxhash64("k", "source", "n", F.lit(5)), F.lit(BINS)).cast("int")

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = np.array([number[s] for s in pdf["source"]])
                rates = _rates(_memberships(pdf["p"]), at, plan.caps[at], plan.start, plan.history)
                yield pd.DataFrame({"k": pdf["k"], "source": pdf["source"], "n": pdf["n"], "rate": rates, "bin": np.floor(rates * BINS).astype(np.int32) + pdf["draw"]})

    rated = members.withColumn("draw", draw).mapInPandas(rate, "k string, source string, n bigint, rate double, bin int")
    rated = cut(rated.withColumn("row", F.monotonically_increasing_id()))
    # at most (largest repeats + 1) times BINS rows per source
    bins: dict[str, list] = {}
    for r in rated.groupBy("source", "bin").agg(F.sum("n").alias("n")).collect():
        bins.setdefault(r["source"], []).append((r["bin"], r["n"]))
    shift = {s: _shifts(*(np.array(x) for x in zip(*rows)), wanted_by[number[s]].repeats, float(plan.wanted[number[s]])) for s, rows in bins.items()}
    if not shift:
        return spark.createDataFrame([], schema)
    cap = F.create_map(*[x for t in wanted_by for x in (F.lit(t.source), F.lit(t.repeats))])[F.col("source")]
    moved = F.create_map(*[x for s, v in shift.items() for x in (F.lit(s), F.lit(v))])[F.col("source")]
    copies = F.greatest(F.lit(0), F.least(cap, F.floor((F.col("bin") + moved) / F.lit(BINS)).cast("int")))
    placed = rated.select("row", "k", "source", "n", "rate", "bin", copies.alias("copies"), cap.alias("cap"))
    # lengths at which a document may come in, come once more, or go: at most MAX_LENGTH per source
    counted = placed.where(F.col("n").between(1, MAX_LENGTH)).groupBy("source", "n").agg(F.count_if(F.col("copies") < F.col("cap")).alias("more"), F.count_if(F.col("copies") > 0).alias("fewer")).collect()
    reached = {r["source"]: r["t"] for r in placed.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("t")).collect()}
    changes = []
    for s in shift:
        own = sorted((r["n"], r["more"], r["fewer"]) for r in counted if r["source"] == s)
        if own:
            lengths, more, fewer = (np.array(x) for x in zip(*own))
            change, _ = exchanges(lengths, more, fewer, float(plan.wanted[number[s]]) - float(reached[s]))
            changes += [(s, n, c) for n, c in change.items()]
    if changes:
        table = F.broadcast(spark.createDataFrame(changes, "source string, n bigint, change int"))  # a few rows per source
        open_ = placed.join(table, ["source", "n"]).where(F.when(F.col("change") > 0, F.col("copies") < F.col("cap")).otherwise(F.col("copies") > 0))
        # only rows of the few lengths that change are ranked; the limit lets each task keep the first ones only
        turn = F.row_number().over(Window.partitionBy("source", "n").orderBy(F.desc("bin"), "row"))
        first = open_.withColumn("turn", turn).where(F.col("turn") <= 2 * ROUNDS).where(F.col("turn") <= F.abs("change"))
        first = first.select("row", F.signum("change").cast("int").alias("step"))
        placed = placed.join(F.broadcast(first), "row", "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0)))
    return placed.select(F.col("k").cast(kind).alias(key), "source", F.col("n").alias("tokens"), "rate", "copies")


def expand(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target and reached share of the tokens, documents used, copies, and most copies of one."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > 0).alias("documents"), F.sum("copies").cast("bigint").alias("copies"), F.max("copies").alias("most_copies"), F.sum("tokens").alias("tokens_available")
    )
    wanted = targets.select("source", "target_share", "max_repeats").where("source is not null").distinct()
    joined = wanted.join(got, "source", "left")
    # the total over at most MAX_SOURCES rows
    total = F.sum(F.coalesce(F.col("tokens"), F.lit(0))).over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("share", F.round(F.coalesce(F.col("tokens"), F.lit(0)) / total, 6))
