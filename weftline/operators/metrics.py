"""Counters, gauges and histograms over label sets, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.running import running_sum

#: Fixed values: (start, factor, count) of the bounds of job duration and queue wait, and the usual bounds of request times.
DURATION_BOUNDS = (0.1, 2, 15)
WAIT_BOUNDS = (0.1, 2, 10)
HTTP_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def exponential_bounds(start: float, factor: float, count: int) -> list[float]:
    return [start * factor**i for i in range(count)]


def counter(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))


def histogram(rows: DataFrame, value: str, bounds: list[float], *labels: str) -> DataFrame:
    """(labels, le, bucket_count, sum, count): cumulative counts per bound, the last bound being infinite.

    One aggregate with a counter per bound, so empty buckets are there and no join is needed. Null values count nowhere.
    """
    v = F.col(value)
    counts = [F.count_if(v <= b).alias(f"__{i}") for i, b in enumerate(bounds)]
    per = rows.where(v.isNotNull()).groupBy(*labels).agg(*counts, F.sum(v).alias("sum"), F.count(F.lit(1)).alias("count"))
    buckets = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"__{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n")))
    return per.withColumn("b", F.explode(buckets)).select(*labels, F.col("b.le").alias("le"), F.col("b.n").alias("bucket_count"), "sum", "count")


def gauge(deltas: DataFrame, delta: str, order: list[str], *labels: str) -> DataFrame:
    """deltas with the running total per label set after each of them."""
    return running_sum(deltas, delta, order, list(labels), "value")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def exposition(rows: DataFrame, name: str, value: str, *labels: str) -> DataFrame:
    """(line): one line of the text format per row; null labels are left out."""
    pairs = F.concat_ws(",", *[F.when(F.col(x).isNotNull(), F.concat(F.lit(f'{x}="'), _escaped(F.col(x)), F.lit('"'))) for x in labels]) if labels else F.lit("")
    return rows.select(F.concat(F.lit(name), F.when(pairs != "", F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), F.col(value).cast("string")).alias("line"))
