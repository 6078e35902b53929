"""Control events and their subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.running import running_sum
from weftline.session import fresh

#: Kinds of control events.
CANCEL, PAUSE, RESUME = 0, 1, 2


def fan_out(events: DataFrame, subscriptions: DataFrame, key: str = "id") -> DataFrame:
    """A copy of every event for every open subscription of its job; events of jobs without any are dropped."""
    return events.join(subscriptions, key)


def sent(events: DataFrame, subscriptions: DataFrame, key: str = "id") -> DataFrame:
    """The events that had a subscription."""
    return events.join(subscriptions.select(key), key, "left_semi")


def buffered(events: DataFrame, subscriptions: DataFrame, channel: str, order: list[str], most: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(copies that fit into their channel's buffer, dropped copies per channel): the first ``most`` of each channel fit.

    Ranks come from stretches of a range partitioning, so a channel with a large part of all events fills no one task.
    """
    (one, rank) = fresh(events.join(subscriptions, key), "one", "rank")
    ranked = running_sum(fan_out(events, subscriptions, key).withColumn(one, F.lit(1)), one, order, [channel], rank, inclusive=False)
    kept, over = ranked.where(F.col(rank) < most), ranked.where(F.col(rank) >= most)
    return kept.drop(one, rank), over.groupBy(channel).agg(F.count(F.lit(1)).alias("dropped"))


def runnable(jobs: DataFrame, events: DataFrame, order: list[str], key: str = "id", kind: str = "type") -> DataFrame:
    """Jobs whose last control event does not pause or cancel them; jobs without events run."""
    last = events.groupBy(key).agg(F.max_by(kind, F.struct(*order)).alias("__last"))
    return jobs.join(last, key, "left").where(F.col("__last").isNull() | (F.col("__last") == RESUME)).drop("__last")
