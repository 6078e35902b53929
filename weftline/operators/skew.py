"""Results per key where a handful of keys hold most rows.

A frequent-items sketch (one pass, mergeable, bounded size) names the keys that may be heavy. Their rows meet a
broadcast table of those few keys and are reduced by (key, item) before they meet by key; all other rows take the
ordinary shuffle. Which keys the sketch names only changes the route, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import fresh


def heavy_keys(rows: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys that may hold at least ``share`` of the non-null rows: at most 2/share of them, by a frequent-items sketch."""
    k = max(1, min(10_000, int(2 / share)))
    tracked = min(1_000_000, 8 * k)
    sketch = rows.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {k}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    if not sketch["n"]:
        return []
    return [x["item"] for x in sketch["top"] if x["count"] >= share * sketch["n"]]


def count_messages(rows: DataFrame, key: str, item: str, share: float = 0.01) -> DataFrame:
    """(key, messages, heavy): per key the distinct non-null items plus the rows whose item is null.

    Rows with a null key belong to no key and are left out. Repeated rows count once unless their item is null.
    An empty table gives an empty result. Any number of extra columns may be there; they are not read.
    """
    (k,) = fresh(rows.select(key, item), "heavy_key")
    rows = rows.select(key, item).where(F.col(key).isNotNull())
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    keys = spark.createDataFrame([(x,) for x in heavy_keys(rows, key, share)], f"`{k}` {kind}")
    own = F.col(key) == F.col(k)
    n_of = F.sum(F.when(F.col(item).isNull(), F.col("n")).otherwise(F.lit(1))).cast("bigint")
    heavy = rows.join(F.broadcast(keys), own, "left_semi").groupBy(key, item).agg(F.count(F.lit(1)).alias("n"))
    light = rows.join(F.broadcast(keys), own, "left_anti")
    return (
        heavy.groupBy(key).agg(n_of.alias("messages")).withColumn("heavy", F.lit(True))
        .unionByName(
            light.groupBy(key)
            .agg((F.count_distinct(F.col(item)) + F.count_if(F.col(item).isNull())).cast("bigint").alias("messages"))
            .withColumn("heavy", F.lit(False))
        )
    )


def unequal_totals(totals: DataFrame, counted: DataFrame, key: str, total: str) -> DataFrame:
    """Keys of ``totals`` whose non-null total differs from the counted messages (0 where none were counted)."""
    joined = totals.where(F.col(total).isNotNull()).join(counted, key, "left")
    return joined.withColumn("messages", F.coalesce(F.col("messages"), F.lit(0))).where(F.col(total) != F.col("messages"))
