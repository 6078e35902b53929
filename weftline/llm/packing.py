"""Filling fixed-capacity containers with documents.

A document's place depends on its length only, and there are at most as many lengths as the capacity has tokens. So
the instance is a histogram: it is reduced and packed on the driver as runs of equal containers, and the documents
find their container by their rank among those of equal length. First the Martello-Toth reduction fixes sets that
dominate every alternative for their largest item; the rest is packed best-fit in decreasing order.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Run = tuple[int, list[tuple[int, int]]]  # equal containers: how many, and (size, items of it) in each
MAX_CAPACITY = 1_000_000  # the histogram on the driver has one entry per size, so this bounds it


class _Sizes:
    """The sizes still to be packed, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)
        # the same once more for steps over all sizes
        self.size_array, self.count_array = np.array(self.sizes, dtype=np.int64), np.array([self.counts[s] for s in self.sizes], dtype=np.int64)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        at = bisect_right(self.sizes, size) - 1
        self.count_array[at] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.pop(at)
            self.size_array, self.count_array = np.delete(self.size_array, at), np.delete(self.count_array, at)

    def largest(self, room: int, without: int | None = None) -> int | None:
        """The largest size that fits; ``without``: one item of that size is already used."""
        at = bisect_right(self.sizes, room) - 1
        while at >= 0:
            size = self.sizes[at]
            if size != without or self.counts[size] > 1:
                return size
            at -= 1
        return None

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest items, one of size ``without`` set aside."""
        out: list[int] = []
        for size in self.sizes:
            have = self.counts[size] - (size == without)
            out += [size] * min(have, n - len(out))
            if len(out) == n:
                break
        return out


def _dominating(left: _Sizes, size: int, capacity: int) -> list[int] | None:
    """What to put beside an item of this size so that no other filling can be better, or None if that is not known."""
    room = capacity - size
    best = left.largest(room, without=size)
    if best is None:
        return []
    if best == room:
        return [best]
    few = left.smallest(3, without=size)
    fitting = sum(np.cumsum(few) <= room)
    if fitting == 1:
        return [best]
    if fitting == 2 and (len(few) < 3 or sum(few) > room):
        # at most two more items fit: for every size, the largest partner that fits beside it
        fits = bisect_right(left.sizes, room)
        sizes = left.size_array[:fits]
        free = left.count_array[:fits] - (sizes == size)
        own = np.arange(len(sizes))
        partner = np.searchsorted(sizes, room - sizes, side="right") - 1
        for _ in range(2):  # a size of which no other item is there stands back for the next smaller one
            taken = np.where(partner >= 0, free[partner] - (partner == own), 1) <= 0
            partner = partner - taken
        paired = (free > 0) & (partner >= 0)
        partner_size = np.where(paired, sizes[partner], 0)
        # the larger of the lesser partners over all feasible pairs
        halves = np.flatnonzero(paired & (sizes <= room // 2))
        least = int(min(sizes[halves[-1]], partner_size[halves[-1]])) if len(halves) else 0
        beside = int(partner_size[-1]) if paired[-1] and sizes[-1] == best else None
        if sizes[-1] != best:  # the largest size is the item's own
            at = int(np.searchsorted(sizes, best))
            beside = int(partner_size[at]) if paired[at] else None
        widest = int((sizes + partner_size)[paired].max(initial=0))
        if best >= widest:
            return [best]
        if beside is not None and beside >= least:
            return [best, beside]
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Runs fixed by dominance, and the sizes left over; repeated until no item can be fixed."""
    left, runs = _Sizes(counts), []
    changed = True
    while changed and left.sizes:
        changed = False
        for size in list(reversed(left.sizes)):
            while left.counts.get(size):
                beside = _dominating(left, size, capacity)
                if beside is None:
                    break
                members: dict[int, int] = {}
                for s in [size, *beside]:
                    members[s] = members.get(s, 0) + 1
                times = min(left.counts[s] // n for s, n in members.items())
                for s, n in members.items():
                    left.take(s, n * times)
                runs.append((times, sorted(members.items(), reverse=True)))
                changed = True
    return runs, left.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing, container by container, with equal containers kept as one run."""
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}  # room left: [how many, filling]

    def add(room: int, n: int, filling: list) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_[room].append([n, filling])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_right(rooms, size - 1)
            if at < len(rooms):
                room = rooms[at]
                group = open_[room]
                have, filling = group.pop()
            else:
                room, have, filling, group = capacity, n, [], [None]
            # the container that takes one item has less room than before and so takes the next, until it is full
            each = room // size
            full = min(have, n // each)
            if full:
                add_room, add_n, add_each = room - each * size, full, each
            else:
                add_room, add_n, add_each = room - n * size, 1, n
            if filling and have > add_n:
                group.append([have - add_n, filling])
            if at < len(rooms) and room in open_ and not open_[room]:
                del open_[room]
                rooms.pop(at)
            n -= add_n * add_each
            add(add_room, add_n, [*filling, (size, add_each)])
    return [(n, filling) for groups in open_.values() for n, filling in groups]


def solve(counts: dict[int, int], capacity: int) -> list[Run]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: the first rank of each run of it, the run's first container, and the items per container."""
    used: dict[int, int] = {}
    table: dict[int, list[tuple[int, int, int]]] = {}
    container = 0
    for times, filling in runs:
        for size, each in filling:
            table.setdefault(size, []).append((used.get(size, 0), container, each))
            used[size] = used.get(size, 0) + times * each
        container += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in table.items()}  # type: ignore[misc]


def pack(documents: DataFrame, profiles: DataFrame, key: str = "doc_id", tokens: str = "tokens", slice_rows: int = 1_000_000) -> DataFrame:
    """(profile, key, piece, tokens, container) for every document and profile.

    documents has key and length; profiles has profile and capacity_tokens and is a small fixed table. A document
    over the capacity is split into full pieces and a rest, numbered from 0; any other is piece 0 and whole. Null
    lengths count 0; a document of no tokens needs no room and has container null. Repeated rows and null keys are
    packed row by row. Containers are numbered from 0 within a profile.
    """
    spark = documents.sparkSession
    kinds = [(r["profile"], int(r["capacity_tokens"])) for r in profiles.select("profile", "capacity_tokens").where("profile is not null and capacity_tokens > 0").distinct().limit(1001).collect()]
    if len(kinds) > 1000 or any(c > MAX_CAPACITY for _, c in kinds):
        raise ValueError("at most 1000 profiles of at most a million tokens each")
    capacity = F.create_map(*[x for p, c in kinds for x in (F.lit(p), F.lit(c).cast("bigint"))]) if kinds else None
    if capacity is None:
        return spark.createDataFrame([], f"profile string, `{key}` {documents.schema[key].dataType.simpleString()}, piece bigint, tokens bigint, container bigint")
    length = F.coalesce(F.col(tokens).cast("bigint"), F.lit(0))
    rows = documents.select(F.col(key).alias("k"), length.alias("n")).withColumn("profile", F.explode(F.array(*[F.lit(p) for p, _ in kinds]))).withColumn("c", capacity[F.col("profile")])
    last = F.greatest(F.ceil(F.col("n") / F.col("c")) - 1, F.lit(0)).cast("bigint")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("size", F.least(F.col("n") - F.col("piece") * F.col("c"), F.col("c")))
    histogram = pieces.where("size > 0").groupBy("profile", "size").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict[int, int]] = {}
    for r in histogram.collect():  # at most capacity rows per profile, and MAX_CAPACITY bounds that
        counts.setdefault(r["profile"], {})[r["size"]] = r["n"]
    places = spark.sparkContext.broadcast({p: _places(solve(counts.get(p, {}), c)) for p, c in kinds})
    # rank among pieces of equal size: within slices of bounded size, then by the slices' offsets
    large = [(p, s, -(-n // slice_rows)) for p, own in counts.items() for s, n in own.items() if n > slice_rows]
    slices = F.lit(1)
    if large:
        table = spark.createDataFrame(large, "lp string, ls bigint, slices bigint")
        pieces = pieces.join(F.broadcast(table), (F.col("profile") == F.col("lp")) & (F.col("size") == F.col("ls")), "left")
        slices = F.coalesce(F.col("slices"), F.lit(1))
    sliced = pieces.select("profile", "k", "piece", "size", F.pmod(F.xxhash64("k", "piece"), slices).cast("int").alias("slice"))
    offsets = sliced.groupBy("profile", "size", "slice").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("profile", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("profile", "size", "slice", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("profile", "size", "slice").orderBy("k", "piece")
    ranked = sliced.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["profile", "size", "slice"])

    @F.pandas_udf("bigint")
    def container(profile: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.full(len(size), -1, dtype=np.int64)
        for (p, s), at in pd.DataFrame({"p": profile, "s": size}).groupby(["p", "s"]).indices.items():
            if s:
                first, start, each = places.value[p][s]
                r = rank.to_numpy()[at]
                run = np.searchsorted(first, r, side="right") - 1
                out[at] = start[run] + (r - first[run]) // each[run]
        return pd.Series(out)

    placed = ranked.withColumn("at", container("profile", "size", (F.col("rank") + F.col("offset")).cast("bigint")))
    return placed.select("profile", F.col("k").alias(key), "piece", F.col("size").alias("tokens"), F.when(F.col("at") >= 0, F.col("at")).alias("container"))


def fill_report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile: documents' pieces, tokens, containers, the least number possible by volume, and the share filled."""
    used = packed.groupBy("profile").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), (F.max("container") + 1).alias("containers"))
    c = F.col("capacity_tokens")
    joined = used.join(profiles.select("profile", "capacity_tokens").where("capacity_tokens > 0").distinct(), "profile")
    return joined.withColumn("least_containers", F.ceil(F.col("tokens") / c)).withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * c), 6))
