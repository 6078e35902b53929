"""Running sums per key that no single task has to hold, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, fresh


def running_sum(rows: DataFrame, amount: str, order: list[str], keys: list[str], into: str, inclusive: bool = True) -> DataFrame:
    """rows with the sum of ``amount`` over the rows of their keys up to them, or before them.

    The rows are range-partitioned by keys and order, which cuts a large key into stretches; each stretch gets its
    own running sum and the total of the stretches before it. Nulls among the keys are a key of their own; a null
    amount adds nothing. Rows that tie in ``order`` come in any order, so give a unique one.
    """
    part, local, offset, total = fresh(rows, "part", "local", "offset", "total")
    by = [F.col(c) for c in (*keys, *order)]
    # the stretch a row falls into must stay the same in both uses below, so it is written down first
    ranged = cut(rows.repartitionByRange(*by).withColumn(part, F.spark_partition_id()))
    totals = ranged.groupBy(*keys, part).agg(F.coalesce(F.sum(amount), F.lit(0)).alias(total))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn(offset, F.coalesce(F.sum(total).over(before), F.lit(0))).drop(total)
    names = {k: f"{part}_{i}" for i, k in enumerate([*keys, part])}
    offsets = offsets.select(*[F.col(k).alias(n) for k, n in names.items()], offset)
    own = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    summed = ranged.withColumn(local, F.coalesce(F.sum(amount).over(own), F.lit(0)))
    match = None
    for k, n in names.items():
        one = F.col(k).eqNullSafe(F.col(n))
        match = one if match is None else match & one
    return summed.join(offsets, match).withColumn(into, F.col(local) + F.col(offset)).select(*rows.columns, into)
