"""Live status cells: the last write wins; and what time has run out on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.checks import is_final


def latest(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value) of the last write per key: an aggregate, so a key written very often is combined before the shuffle."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def without(log: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """The log without deleted keys; deleting an unknown key does nothing."""
    return log.join(deleted.select(key), key, "left_anti")


def overlay(stored: DataFrame, live: DataFrame, key: str, value: str) -> DataFrame:
    """stored with the live value where there is one."""
    named = live.select(F.col(key), F.col(value).alias("__live"))
    return stored.join(named, key, "left").withColumn(value, F.coalesce(F.col("__live"), F.col(value))).drop("__live")


def alive(set_at: Column, ttl: Column, as_of: Column) -> Column:
    """Whether ttl seconds after set_at (epoch seconds) are not over; a null or non-positive ttl never ends."""
    return ttl.isNull() | (ttl <= 0) | (set_at + ttl > as_of)


def missed(slo: Column, status: Column, as_of: Column, started_at: Column | None = None) -> Column:
    """Whether the deadline passed before the job came to an end, or, with ``started_at``, before it began.

    A deadline on the start is met by a job that started at the deadline or before; on a null start it is missed once
    it has passed.
    """
    if started_at is not None:
        return (slo < as_of) & ~F.coalesce(started_at <= slo, F.lit(False))
    return (slo < as_of) & ~F.coalesce(is_final(status), F.lit(False))


def retained(created_at: Column, months: int, as_of: Column) -> Column:
    """Whether a record of this moment is still kept ``months`` months later; one without a moment is."""
    return created_at.isNull() | (F.add_months(created_at.cast("date"), months) > as_of.cast("date"))
