"""Requests of a job: parameters, the inference step, results, tallies, errors, limits."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.checks import RETRYABLE
from weftline.operators.running import running_sum
from weftline.session import cut, fresh

_FREE = nullcontext()
RESULT = "request_id string, job_id string, response string, category string, message string, attempts int"


class InferenceError(Exception):
    """What a client raises to name the category of a failure."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category, self.message = category, message


def parameters(lines: DataFrame, body: str = "request_body") -> DataFrame:
    """(request_id, model, params): bodies that are no JSON have null params."""
    return lines.select("request_id", "model", F.try_parse_json(F.col(body)).alias("params"))


def with_defaults(line: Column, model: Column, api: Column, everywhere: Column) -> Column:
    """The most particular value that is set."""
    return F.coalesce(line, model, api, everywhere)


def run_lines(lines: DataFrame, client: Callable[[], Callable[[str, str, str], str]], parallel: int, retries: int = 2, wait: float = 0.0, per_model: Mapping[str, int] | None = None) -> DataFrame:
    """Every line (request_id, job_id, model, request_body) through the client; failures become error rows.

    ``client`` is called once per task and gives the function that answers (request_id, model, body). Each task keeps
    up to ``parallel`` calls in flight, and of a model named in ``per_model`` no more than that many; how many tasks
    there are is left to the plan, so the number of rows sets no limit and no key gathers in one task. Failures of a
    retryable category are tried again; any other exception is an error of that line alone, of category UNKNOWN. Rows
    keep their order within a task.
    """
    limits = dict(per_model or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = client()
        slots = {m: threading.Semaphore(n) for m, n in limits.items()}

        def one(line: tuple) -> tuple:
            request_id, job_id, model, body = line
            with slots.get(model, _FREE):
                for attempt in range(1, retries + 2):
                    response = category = message = None
                    try:
                        response = answer(request_id, model, body)
                    except InferenceError as e:
                        category, message = e.category, e.message
                    except Exception as e:  # noqa: BLE001
                        category, message = "UNKNOWN", str(e) or type(e).__name__
                    if category not in RETRYABLE:
                        break
                    if attempt <= retries and wait:
                        time.sleep(wait)
            return request_id, job_id, response, category, message, attempt

        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            for pdf in batches:
                lines_here = zip(pdf["request_id"], pdf["job_id"], pdf["model"], pdf["request_body"])
                rows = list(map(one, lines_here) if parallel <= 1 else pool.map(one, lines_here))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return lines.select("request_id", "job_id", "model", "request_body").mapInPandas(run, RESULT)


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(output rows, error rows); write both from one materialised frame."""
    return results.where(F.col("category").isNull()).drop("category", "message"), results.where(F.col("category").isNotNull()).drop("response")


def write_results(results: DataFrame, location: str, rows_per_file: int = 50_000) -> tuple[str, str]:
    """Per job a folder of output lines and one of error lines, as line-wise JSON; gives both locations.

    The folders are ``<location>/output/job_id=...`` and ``<location>/errors/job_id=...``. The results are written down
    once and read twice. Rows of a job are spread over as many tasks as its size asks for, so that a job of a third of
    all rows gets many files, and a small one gets one; no file holds more than ``rows_per_file``. Rows without a job
    go to the folder of the null job. Files of another run are replaced.
    """
    spread, n = fresh(results, "spread", "n")
    held = cut(results)
    sizes = held.groupBy(F.col("job_id").alias(spread)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > rows_per_file)
    slices = F.coalesce(F.ceil(F.col(n) / F.lit(rows_per_file)), F.lit(1))
    placed = held.join(sizes, F.col("job_id") == F.col(spread), "left").withColumn(n, F.pmod(F.xxhash64("request_id"), slices)).drop(spread)
    places = (f"{location}/output", f"{location}/errors")
    for part, place in zip(split_results(placed), places):
        own = part.repartition("job_id", n).drop(n)
        own.write.mode("overwrite").partitionBy("job_id").option("maxRecordsPerFile", rows_per_file).json(place)
    return places


def answers(requests: DataFrame, responses: DataFrame, on: list[str]) -> DataFrame:
    """Every request with its response, or null."""
    return requests.join(responses, on, "left")


def tally(lines: DataFrame, failed: Column, job: str = "job_id") -> DataFrame:
    """(job, total, succeeded, failed)."""
    return lines.groupBy(job).agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))


def progress(total: Column, completed: Column, failed: Column) -> Column:
    """The part of a job that is done; null for a job without lines."""
    return F.when(total > 0, (completed + failed) / total)


def error_list(errors: DataFrame, job: str = "job_id", span: int = 1000) -> DataFrame:
    """(job, chunk, errors): per job its errors in order of their lines, in chunks of at most ``span`` errors.

    Chunks follow the errors' rank in their job, counted from 0, so that neither a large job, nor errors without a line,
    nor a line reported over and over gathers in one list. Errors without a line come first.
    """
    (rank, one) = fresh(errors, "rank", "one")
    ranked = running_sum(errors.withColumn(one, F.lit(1)), one, ["line", "code", "message", "param"], [job], rank, inclusive=False)
    chunk = F.floor(F.col(rank) / F.lit(span)).cast("bigint").alias("chunk")
    return ranked.groupBy(job, chunk).agg(F.array_sort(F.collect_list(F.struct("line", "code", "message", "param"))).alias("errors"))


def remaining(lines: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Lines that have no result yet."""
    return lines.join(done.select(*on), on, "left_anti")


def until_threshold(lines: DataFrame, job: str, order: list[str], amount: Column, most: int) -> DataFrame:
    """The lines of each job up to and including the one with which the running amount exceeds ``most``."""
    spent = running_sum(lines.withColumn("__amount", amount), "__amount", order, [job], "spent", inclusive=False)
    return spent.where(F.col("spent") <= most).drop("__amount")


def over_rate(events: DataFrame, user: str, at: str, period: str, most: int) -> DataFrame:
    """(user, period_start, n) of the periods in which a user sent more than ``most``."""
    counted = events.groupBy(user, F.window(at, period).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > most).select(user, F.col("w.start").alias("period_start"), "n")


def usage(responses: DataFrame, response: str = "response") -> DataFrame:
    """Token counts of each response; the two naming schemes of chat and response bodies meet in one."""
    v = F.try_parse_json(F.col(response))

    def read(*paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, f"$.usage.{p}", "bigint") for p in paths])

    return responses.select(
        "*",
        read("input_tokens", "prompt_tokens").alias("input_tokens"),
        read("input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens").alias("cached_tokens"),
        read("output_tokens", "completion_tokens").alias("output_tokens"),
        read("output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"),
        read("total_tokens").alias("total_tokens"),
    )


def grouped(lines: DataFrame, *by: str, rows: int = 100_000) -> DataFrame:
    """Lines of one model and endpoint next to each other, for servers that gain from it.

    A group of more than ``rows`` lines is cut into stretches of about that many, each in one task; small groups share tasks.
    """
    (n, part) = fresh(lines, "n", "part")
    names = {c: f"{n}_{i}" for i, c in enumerate(by)}
    large = lines.groupBy(*[F.col(c).alias(x) for c, x in names.items()]).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > rows)
    match = None
    for c, x in names.items():
        same = F.col(c).eqNullSafe(F.col(x))
        match = same if match is None else match & same
    stretches = F.coalesce(F.ceil(F.col(n) / F.lit(rows)), F.lit(1))
    cut_up = lines.join(large, match, "left").withColumn(part, F.floor(F.rand(7) * stretches).cast("int")).drop(n, *names.values())
    return cut_up.repartition(*by, part).sortWithinPartitions(*by, part).drop(part)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str, vector: str, label: str, block: int = 1_000) -> DataFrame:
    """(key, label, distance) of the nearest centroid by squared distance, on a tie the least label.

    The centroids are cut into blocks of at most ``block``, each held as one matrix; a batch of vectors meets block after
    block, so any number of centroids is allowed that the workers can hold. Null vectors and null centroids, and those of
    another length, meet nothing; a vector that meets no centroid gives no row.
    """
    import numpy as np

    rows = centroids.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).orderBy("label").collect()
    by_width: dict[int, list] = {}
    for r in rows:
        by_width.setdefault(len(r["v"]), []).append(r)
    blocks = {w: [([x["label"] for x in own[i : i + block]], np.array([x["v"] for x in own[i : i + block]], dtype=np.float64)) for i in range(0, len(own), block)] for w, own in by_width.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(blocks)
    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, `{label}` {centroids.schema[label].dataType.simpleString()}, distance double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, labels, distances = [], [], []
            widths = pdf["v"].map(len)
            for width, own in shared.value.items():
                part = pdf[widths == width]
                if not len(part):
                    continue
                x = np.stack(part["v"].to_numpy())
                best, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=object)
                for names, c in own:
                    d = np.stack([np.square(x - row).sum(1) for row in c], 1)
                    near = d.argmin(1)
                    value = d[np.arange(len(x)), near]
                    # blocks go up in labels, so only a smaller distance wins
                    less = value < best
                    best, at = np.where(less, value, best), np.where(less, np.array(names, dtype=object)[near], at)
                keys += part["k"].tolist()
                labels += at.tolist()
                distances += np.round(best, 6).tolist()
            yield pd.DataFrame({key: keys, label: labels, "distance": distances})

    read = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return read.mapInPandas(run, schema)
