"""A queue ordered by deadline, equal deadlines in order of arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, fresh


SMALL = 100_000  # taken entries that are broadcast; more of them are joined


def order(slo: str = "slo", seq: str = "enqueue_seq") -> list[Column]:
    return [F.col(slo).asc_nulls_last(), F.col(seq).asc()]


def enqueue(queue: DataFrame, new: DataFrame, seq: str = "enqueue_seq", arrival: str = "arrival") -> DataFrame:
    """queue with the new entries numbered on from its largest number, in order of arrival.

    The numbers come from per-partition counts after a range partitioning by arrival, not from one sorted task.
    """
    last = queue.agg(F.coalesce(F.max(seq), F.lit(0))).first()[0]
    (mark, part) = fresh(new, "mark", "part")
    ranged = cut(new.repartitionByRange(F.col(arrival)).sortWithinPartitions(arrival).withColumn(mark, F.monotonically_increasing_id()))
    # the mark holds the partition in its upper bits and the row's place in it in the lower 33
    ranged = ranged.withColumn(part, F.shiftright(mark, 33))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # one row per partition
    place = F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ranged.join(F.broadcast(offsets), part).withColumn(seq, (F.col("offset") + place + 1 + last).cast("bigint"))
    return queue.unionByName(numbered.select(*queue.columns))


def remove_first(queue: DataFrame, ids: DataFrame, key: str = "id", seq: str = "enqueue_seq") -> tuple[DataFrame, DataFrame]:
    """(the queue without the first entry of each id, the ids that were not queued)."""
    first = queue.join(ids.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min_by(seq, F.struct(F.col("slo").isNull(), F.col("slo"), F.col(seq))).alias(seq))
    return queue.join(first.select(seq), seq, "left_anti"), ids.select(key).distinct().join(queue.select(key), key, "left_anti")


def dequeue(queue: DataFrame, k: int, seq: str = "enqueue_seq", by: Sequence[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the k first entries, the rest); told apart by entry number, as an id may be queued twice.

    The order is by deadline, or the caller's own ``by``, with the entry number last so that it is a total one.
    """
    taken = queue.orderBy(*(order(seq=seq) if by is None else [*by, F.col(seq).asc()])).limit(k)
    gone = taken.select(seq)
    return taken, queue.join(F.broadcast(gone) if k <= SMALL else gone, seq, "left_anti")


def put_back(queue: DataFrame, taken: DataFrame, jobs: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(entries whose job is there, the queue with the other ones in it again under their old numbers).

    A null id has no job.
    """
    known = jobs.select(key).distinct()
    return taken.join(known, key, "left_semi"), queue.unionByName(taken.join(known, key, "left_anti").select(*queue.columns))


def dequeue_each(queue: DataFrame, by: str, k: int, seq: str = "enqueue_seq") -> DataFrame:
    """The k entries of nearest deadline of each of several queues."""
    window = Window.partitionBy(by).orderBy(*order(seq=seq))
    return queue.withColumn("turn", F.row_number().over(window)).where(F.col("turn") <= k)
