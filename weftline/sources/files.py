"""Request files and their metadata through the file system Spark knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.codec import LINE
from weftline.session import cut, remove


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(location, size, mod_time) of the files that match; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("location"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"))


def retrieve(spark: SparkSession, location: str) -> tuple[DataFrame, DataFrame]:
    """(lines of the file, its metadata)."""
    return spark.read.text(location), list_files(spark, location)


def read_lines(spark: SparkSession, location: str) -> DataFrame:
    """(location, line, value): the lines of each file, numbered from 1.

    Large files are read in splits. Numbers come from the order of splits in a file and a count per split.
    """
    read = spark.read.text(location).select(F.col("_metadata.file_path").alias("location"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("mark"))
    read = cut(read)
    blocks = read.groupBy("location", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("first"))
    # splits per file are few: file size over split size
    listed = blocks.groupBy("location").agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("all"))
    before = F.aggregate(F.filter("all", lambda x: x["block"] < F.col("block")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    offsets = blocks.join(listed, "location").select("location", "block", "first", before.alias("before"))
    return read.join(offsets, ["location", "block"]).select("location", (F.col("before") + F.col("mark") - F.col("first") + 1).alias("line"), "value")


def read_requests(spark: SparkSession, location: str) -> DataFrame:
    """(location, line, request_id, method, end_point, request_body, valid) of line-wise JSON requests; blank lines are skipped."""
    parsed = read_lines(spark, location).where(F.trim("value") != "").withColumn("r", F.from_json("value", LINE))
    return parsed.select("location", "line", F.col("r.custom_id").alias("request_id"), F.col("r.method").alias("method"), F.col("r.url").alias("end_point"), F.col("r.body").alias("request_body"), F.coalesce(F.col("r.custom_id").isNotNull(), F.lit(False)).alias("valid"))


def store(rows: DataFrame, location: str, limit: int, column: str = "value") -> int:
    """Write lines as text unless they take more than ``limit`` bytes; gives the bytes."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length(column) + 1), F.lit(0))).first()[0]
    if size > limit:
        raise ValueError(f"{size} bytes are over the limit of {limit}")
    rows.select(column).write.text(location)
    return size


def delete(spark: SparkSession, location: str) -> bool:
    """Remove a file or folder; false if there was none."""
    return remove(spark, location)
