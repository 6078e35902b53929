"""Job records to and from JSON, and new jobs out of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import duration_seconds
from weftline.operators.checks import batch_request_error

SPEC = "object string, endpoint string, input_file_id string, completion_window string, metadata map<string,string>, created_at bigint"
STATUS = (
    "status string, output_file_id string, error_file_id string, cancelled_at bigint, cancelling_at bigint, completed_at bigint, expired_at bigint, "
    "expires_at bigint, failed_at bigint, finalizing_at bigint, in_progress_at bigint, model string, request_counts struct<total bigint, completed bigint, failed bigint>, "
    "errors struct<object string, data array<struct<code string, message string, param string, line bigint>>>, usage struct<input_tokens bigint, "
    "input_tokens_details struct<cached_tokens bigint>, output_tokens bigint, output_tokens_details struct<reasoning_tokens bigint>, total_tokens bigint>"
)
REQUEST = "input_file_id string, endpoint string, completion_window string, metadata map<string,string>, output_expires_after struct<seconds bigint, anchor string>"
LINE = "custom_id string, method string, url string, body string"


def decode(rows: DataFrame, blob: str, schema: str, into: str) -> DataFrame:
    """rows with the blob as a struct and ``<into>_ok``: false for null, blank, JSON null and anything that is no object."""
    parsed = F.from_json(F.col(blob), schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    fields = [c.strip().split(" ")[0] for c in _split(schema)]
    raw = rows.withColumn("__parsed", parsed)
    sound = F.col(blob).isNotNull() & (F.trim(F.col(blob)) != "") & F.col("__parsed").isNotNull() & F.col("__parsed.__bad").isNull() & F.ltrim(F.col(blob)).startswith("{")
    struct = F.struct(*[F.col(f"__parsed.{f}").alias(f) for f in fields])
    return raw.withColumn(f"{into}_ok", F.coalesce(sound, F.lit(False))).withColumn(into, F.when(F.col(f"{into}_ok"), struct)).drop("__parsed")


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def jobs_as_batches(jobs: DataFrame, strict: bool = False) -> DataFrame:
    """Jobs whose spec and status are JSON texts, flattened under their id.

    Rows of which either text cannot be read are left out; with strict they raise, as for a single look-up.
    """
    decoded = decode(decode(jobs, "spec", SPEC, "spec_parts"), "status", STATUS, "status_parts")
    both = F.col("spec_parts_ok") & F.col("status_parts_ok")
    if strict:
        decoded = decoded.where(F.when(both, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unreadable job "), F.col("id"))).cast("boolean")))
    else:
        decoded = decoded.where(both)
    return decoded.select("id", "spec_parts.*", "status_parts.*")


def flatten(jobs: DataFrame) -> DataFrame:
    """Jobs whose spec and status are structs, flattened under their id."""
    return jobs.select("id", "spec.*", "status.*")


def encode(*columns: Column) -> Column:
    """One JSON text of the columns; null fields are left out."""
    return F.to_json(F.struct(*columns))


def slo(created_at: Column, window: Column) -> Column:
    """created_at (epoch seconds) plus the completion window, as a timestamp of microseconds."""
    micros = (created_at.cast("decimal(38,9)") + duration_seconds(window)) * 1_000_000
    return F.timestamp_micros(micros.cast("bigint"))


def ttl(window: Column, expiry: Column | None, default: int = 2592000) -> Column:
    """Whole seconds a job is kept: window plus expiry where one is set from ``created_at`` on, else the default."""
    if expiry is None:
        return F.lit(default).cast("bigint")
    own = expiry.isNotNull() & F.coalesce(expiry["anchor"], F.lit("")).isin("", "created_at")
    # cast cuts towards zero
    return F.when(own, duration_seconds(window).cast("bigint") + expiry["seconds"]).otherwise(F.lit(default).cast("bigint"))


def create(requests: DataFrame, id_: Column, as_of: Column, default_ttl: int = 2592000) -> tuple[DataFrame, DataFrame]:
    """(new jobs with their queue deadline, rejected requests with the reason) out of parsed job requests.

    Identifiers and the moment are given, so that the same requests give the same jobs.
    """
    window, expiry = F.col("completion_window"), F.col("output_expires_after")
    judged = requests.withColumn("error", batch_request_error(window, F.col("endpoint"), F.col("input_file_id"), expiry))
    sound = judged.where(F.col("error").isNull())
    zero = F.lit(0).cast("bigint")
    jobs = sound.select(
        F.concat(F.lit("batch_"), id_).alias("id"),
        slo(as_of, window).alias("slo"),
        ttl(window, expiry, default_ttl).alias("ttl"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.struct(F.lit("batch").alias("object"), "endpoint", "input_file_id", "completion_window", "metadata", as_of.alias("created_at")).alias("spec"),
        F.struct(F.lit("validating").alias("status"), F.struct(zero.alias("total"), zero.alias("completed"), zero.alias("failed")).alias("request_counts")).alias("status"),
    )
    return jobs, judged.where(F.col("error").isNotNull())
