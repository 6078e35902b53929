"""Messages delivered more than once: exactly one copy of each identifier is kept.

The identifiers are counted first (an aggregate with map-side combine, so a hot identifier is no burden).
Identifiers seen once pass straight through. Only the rows of repeated identifiers are ranked, in two levels:
first within slices of an identifier, then among the slices' winners, so that one identifier may hold a third
of all rows without any task receiving more than about ``slice_rows`` of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, fresh

SMALL = 100_000  # sliced identifiers that are broadcast; more of them are joined


@dataclass(frozen=True)
class Deliveries:
    kept: DataFrame
    surplus: DataFrame


def _ranked(rows: DataFrame, key: str, order: list[str], slice_rows: int) -> tuple[DataFrame, Column, list[str]]:
    n, slices, piece, group, first, last = fresh(rows, "n", "slices", "piece", "group", "first", "last")
    repeated = cut(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(last)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1))
    parts = F.ceil(F.col(n) / F.lit(slice_rows))
    large = repeated.where(F.col(n) > slice_rows).select(F.col(last).alias(group), parts.alias(slices))
    if large.limit(SMALL + 1).count() <= SMALL:
        large = F.broadcast(large)
    sliced = rows.join(large, F.col(key) == F.col(group), "left").withColumn(piece, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.coalesce(F.col(slices), F.lit(1)))).drop(group, slices)
    pieces = repeated.select(F.col(last), F.col(n), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias(slices))
    tagged = sliced.join(pieces, (F.col(key) == F.col(last)) & (F.col(piece) == F.col(slices)), "left").drop(last, slices)
    return tagged, F.col(n).isNotNull(), [n, piece, group, first, last]


def keep_one(rows: DataFrame, key: str, order: list[str], slice_rows: int = 1_000_000) -> Deliveries:
    """One row per identifier ``key``: the least by the columns ``order`` (nulls last).

    Rows with a null identifier cannot be told apart and are all kept. Of rows that agree in every column of
    ``order`` any one is kept; they count as the same delivery. An empty table gives two empty tables. Extra
    columns pass through whatever their names are.
    """
    tagged, is_repeated, (n, piece, group, first, second) = _ranked(rows, key, order, slice_rows)
    by = [F.col(c).asc_nulls_last() for c in order]
    within = Window.partitionBy(F.col(key), F.col(piece)).orderBy(*by)
    among = Window.partitionBy(F.col(key), F.col(group)).orderBy(*by)
    ranked = (
        tagged.where(is_repeated)
        .withColumn(first, F.row_number().over(within))
        .withColumn(group, F.when(F.col(first) == 1, F.lit(-1).cast("long")).otherwise(F.col(piece)))
        .withColumn(second, F.row_number().over(among))
    )
    best = (F.col(first) == 1) & (F.col(second) == 1)
    single = tagged.where(~is_repeated)
    names = rows.columns
    kept = single.select(*[single[c] for c in names]).unionByName(ranked.where(best).select(*names))
    return Deliveries(kept, ranked.where(~best).select(*names))


def deduplicate(stored: DataFrame, new: DataFrame, key: str, order: list[str], slice_rows: int = 1_000_000) -> Deliveries:
    """Stored and newly delivered messages together; a stored row competes by the same order as a new one."""
    return keep_one(stored.unionByName(new, allowMissingColumns=True), key, order, slice_rows)
