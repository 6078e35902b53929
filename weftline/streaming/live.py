"""Structured Streaming forms: polling a queue, live status, event fan-out, time to live, draining."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; the number of files per batch is the back-pressure."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_time(rows: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def latest_status(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Last write per key; write it in complete or update mode."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_deliveries(messages: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Messages without the repeats that come within ``late``."""
    return event_time(messages, at).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def fan_out(events: DataFrame, subscriptions: DataFrame, key: str) -> DataFrame:
    """Events of a stream joined with a table of subscriptions."""
    return events.join(subscriptions, key)


def counts_per_period(events: DataFrame, at: str, period: str, late: str, *labels: str) -> DataFrame:
    """Counts per period and labels; in append mode a period comes out once its watermark has passed."""
    timed = event_time(events, at).withWatermark(at, late)
    counted = timed.groupBy(F.window(at, period).alias("w"), *labels).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("period_start"), *labels, "n")


def poll(queue: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: float = 5.0, once: bool = False) -> StreamingQuery:
    """Hand every batch of queue entries to ``handle``, every ``interval`` seconds, or all there is at once.

    The checkpoint folder lets a restarted query go on where it stopped; handle must take a repeated batch number
    as the same batch.
    """
    writer = queue.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval} seconds")
    return writer.start()


def expiring_state(events: DataFrame, key: str, value: str, ttl_ms: int) -> DataFrame:
    """(key, value, writes): per key the last value and how often it was written within its time to live.

    The state of a key is dropped by the state store ``ttl_ms`` after its last write; it needs the RocksDB provider.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Cell(StatefulProcessor):
        def init(self, handle) -> None:
            self.cell = handle.getValueState("cell", "value string, writes bigint", ttl_ms)

        def handleInputRows(self, k, rows, timer_values):
            old = self.cell.get() if self.cell.exists() else None
            value_, writes = (old[0], old[1]) if old else (None, 0)
            for pdf in rows:
                if len(pdf):
                    value_, writes = str(pdf[value].iloc[-1]), writes + len(pdf)
            self.cell.update((value_, writes))
            yield pd.DataFrame({key: [k[0]], "value": [value_], "writes": [writes]})

        def close(self) -> None:
            pass

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).transformWithStateInPandas(Cell(), f"{key} {kind}, value string, writes bigint", "Update", "ProcessingTime")


def drain(*queries: StreamingQuery, seconds: float = 60.0) -> None:
    """Let running batches end, then stop; a query that is still busy after ``seconds`` is stopped all the same."""
    end = time.monotonic() + seconds
    for q in queries:
        while q.isActive and q.status["isTriggerActive"] and time.monotonic() < end:
            time.sleep(0.1)
        q.stop()


class Deadline:
    """Jobs started inside are cancelled when the time is over."""

    def __init__(self, spark: SparkSession, name: str, seconds: float):
        self.spark, self.name, self.seconds = spark, name, seconds

    def __enter__(self) -> Deadline:
        self.spark.sparkContext.addJobTag(self.name)
        self._timer = threading.Timer(self.seconds, lambda: self.spark.sparkContext.cancelJobsWithTag(self.name))
        self._timer.daemon = True
        self._timer.start()
        return self

    def __exit__(self, *_) -> None:
        self._timer.cancel()
        self.spark.sparkContext.removeJobTag(self.name)
