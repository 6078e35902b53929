"""Row checks: each gives a message for the first rule a row breaks, or null for a sound row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import is_duration, leading_int
from weftline.operators.badrows import END_POINTS

#: States a job does not leave, and error categories worth another try.
FINAL = ("completed", "failed", "expired", "cancelled")
RETRYABLE = ("RATE_LIMIT", "SERVER_ERROR")
#: The wording of what is said of a broken rule; an open place takes the value or id in question.
SAID = {
    "no window": "completion_window is required",
    "bad window": "completion_window must be a valid duration (e.g., 24h)",
    "no endpoint": "endpoint is required",
    "bad endpoint": "invalid endpoint: ",
    "no input file": "input_file_id is required",
    "no anchor": "output_expires_after.anchor is required",
    "bad expiry": "output_expires_after.seconds must be between 3600 (1 hour) and 2592000 (30 days)",
    "no id": "ID is empty",
    "no slo": "SLO is zero for ID ",
    "bad ttl": "TTL is invalid for ID ",
}
#: How long output may live, in seconds.
EXPIRY = (3600, 2592000)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def batch_request_error(window: Column, endpoint: Column, input_file: Column, expiry: Column | None = None) -> Column:
    """The first rule a request for a new job breaks; expiry is a struct of seconds and anchor, or null."""
    chain = (
        F.when(_blank(window), SAID["no window"])
        .when(~is_duration(window), SAID["bad window"])
        .when(_blank(endpoint), SAID["no endpoint"])
        .when(~endpoint.isin(*END_POINTS), F.concat(F.lit(SAID["bad endpoint"]), endpoint))
        .when(_blank(input_file), SAID["no input file"])
    )
    if expiry is not None:
        seconds = F.coalesce(expiry["seconds"], F.lit(0))
        chain = chain.when(expiry.isNotNull() & _blank(expiry["anchor"]), SAID["no anchor"]).when(expiry.isNotNull() & ~seconds.between(*EXPIRY), SAID["bad expiry"])
    return chain


def job_error(id_: Column, slo: Column, ttl: Column) -> Column:
    return (
        F.when(_blank(id_), SAID["no id"])
        .when(slo.isNull(), F.concat(F.lit(SAID["no slo"]), id_))
        .when(F.coalesce(ttl, F.lit(0)) <= 0, F.concat(F.lit(SAID["bad ttl"]), id_))
    )


def event_error(id_: Column, kind: Column, ttl: Column) -> Column:
    return (
        F.when(_blank(id_), SAID["no id"])
        .when(~F.coalesce(kind, F.lit(-1)).between(0, 2), F.concat(F.lit("event type "), kind.cast("string"), F.lit(" is invalid for ID "), id_))
        .when(F.coalesce(ttl, F.lit(0)) <= 0, F.concat(F.lit(SAID["bad ttl"]), id_))
    )


def is_final(status: Column) -> Column:
    return status.isin(*FINAL)


def is_retryable(category: Column) -> Column:
    return category.isin(*RETRYABLE)


def tallies_agree(total: Column, succeeded: Column, failed: Column) -> Column:
    return succeeded + failed == total


def page_limit(text: Column, default: int = 20, most: int = 100) -> Column:
    """The page size a text asks for: the default where blank, null where it is no number from 1 to ``most``."""
    n = leading_int(text)
    return F.when(_blank(text), F.lit(default).cast("bigint")).when(n.between(1, most), n)


def page_start(text: Column) -> Column:
    """The offset a text asks for: 0 where blank, null where it is no number from 0 on."""
    n = leading_int(text)
    return F.when(_blank(text), F.lit(0).cast("bigint")).when(n >= 0, n)


def line_error(request_id: Column, model: Column, end_point: Column, body: Column, end_points: Sequence[str] = END_POINTS, models: Sequence[str] | None = None) -> Column:
    """The first rule a request line breaks; end points and, where given, models must be on the list of allowed ones."""
    listed = F.lit(False) if models is None else ~model.isin(*models)
    return (
        F.when(_blank(request_id), "request_id is required")
        .when(_blank(end_point), "end_point is required")
        .when(~end_point.isin(*end_points), F.concat(F.lit("invalid end_point: "), end_point))
        .when(_blank(model), "model is required")
        .when(listed, F.concat(F.lit("model is not allowed: "), model))
        .when(body.isNull(), "request_body is required")
    )


def observed(path: Column) -> Column:
    """Whether a request path is measured: health and metrics calls are not."""
    return ~path.isin("/metrics", "/health")


def oversize_jobs(lines: DataFrame, job: str, body: str, requests: int = 50_000, size: int = 200_000_000) -> DataFrame:
    """(job, requests, bytes) of the jobs over either limit; one aggregate with map-side combine."""
    counted = lines.where(F.col(job).isNotNull()).groupBy(job).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint")).alias("bytes"))
    return counted.where((F.col("requests") > requests) | (F.col("bytes") > size))
