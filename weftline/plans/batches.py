"""One query per operator of the batch engine over the project's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.operators import checks, codec, events, metrics, process, queue, status, store
from weftline.session import cut, own_folder, remove
from weftline.sources import config, files
from weftline.sources.tables import table
from weftline.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_jobs")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_queue")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "requests")




@query("""
SELECT q.id, j.status.status AS status, epoch_us(q.slo) AS slo, t.total, t.succeeded, t.failed,
  CASE WHEN t.total < 100 THEN '100' WHEN t.total < 1000 THEN '1000' WHEN t.total < 10000 THEN '10000' WHEN t.total < 30000 THEN '30000' WHEN t.total IS NOT NULL THEN 'large' END AS size_bucket
FROM (SELECT q.* FROM job_queue q SEMI JOIN (SELECT id FROM batch_jobs WHERE status.status NOT IN ('completed', 'failed', 'expired', 'cancelled') OR status.status IS NULL) USING (id) ORDER BY slo NULLS LAST, enqueue_seq LIMIT 10) q
JOIN batch_jobs j ON q.id = j.id
LEFT JOIN (SELECT job_id, count(*) AS total, count(*) FILTER (status = 0) AS succeeded, count(*) FILTER (status <> 0) AS failed FROM requests WHERE job_id IS NOT NULL GROUP BY job_id) t ON q.id = t.job_id""")
def urgent_jobs(spark, d):
    """The ten most urgent unfinished jobs with their outcomes and size class."""
    jobs = _jobs(spark, d).select("id", F.col("status.status").alias("status"))
    pending = jobs.where(~F.coalesce(checks.is_final(F.col("status")), F.lit(False)))
    taken, _ = queue.dequeue(_queue(spark, d).join(pending.select("id"), "id", "left_semi"), 10)
    lines = _requests(spark, d).where("job_id is not null")
    tally = process.tally(lines.join(F.broadcast(taken.select(F.col("id").alias("job_id")).distinct()), "job_id", "left_semi"), F.col("status") != 0)
    return (
        taken.join(jobs, "id").join(tally.withColumnRenamed("job_id", "id"), "id", "left")
        .select("id", "status", F.unix_micros("slo").alias("slo"), "total", "succeeded", "failed", scalars.size_bucket(F.col("total")).alias("size_bucket"))
    )


@query("SELECT q.enqueue_seq AS place, j.id, j.ttl FROM job_queue q JOIN batch_jobs j ON q.id = j.id")
def lookup_by_ids(spark, d):
    ids = _queue(spark, d).select(F.col("enqueue_seq").alias("place"), "id")
    return store.by_ids(_jobs(spark, d).select("id", "ttl"), ids).select("place", "id", "ttl")


@query("SELECT id, ttl FROM batch_jobs ORDER BY spec.created_at NULLS FIRST, id LIMIT 50")
def list_jobs(spark, d):
    own, _ = store.page(_jobs(spark, d), [F.col("spec.created_at"), F.col("id")], 50)
    return own.select("id", "ttl")


@query("SELECT id FROM batch_jobs ORDER BY spec.created_at NULLS FIRST, id LIMIT 20 OFFSET 40")
def list_jobs_page_three(spark, d):
    own, _ = store.page(_jobs(spark, d), [F.col("spec.created_at"), F.col("id")], 20, 40)
    return own.select("id")


@query("""
WITH f AS (SELECT id, row_number() OVER (ORDER BY spec.created_at NULLS FIRST, id) AS n FROM batch_jobs QUALIFY n > 40 AND n <= 61)
SELECT coalesce(min_by(id, n) FILTER (n <= 60), '') AS first_id, coalesce(max_by(id, n) FILTER (n <= 60), '') AS last_id, count(*) > 20 AS has_more FROM f""")
def page_envelope(spark, d):
    return store.page(_jobs(spark, d).select("id", "spec"), [F.col("spec.created_at"), F.col("id")], 20, 40)[1]


@query("SELECT id, array_to_string(tags, ',') AS tags FROM batch_jobs WHERE list_has_all(tags, ['eval', 'nightly'])")
def jobs_with_all_tags(spark, d):
    return store.by_tags(_jobs(spark, d), ["eval", "nightly"], every=True).select("id", F.array_join("tags", ",").alias("tags"))


@query("SELECT id, array_to_string(tags, ',') AS tags FROM batch_jobs WHERE list_has_any(tags, ['eval', 'backfill'])")
def jobs_with_any_tag(spark, d):
    return store.by_tags(_jobs(spark, d), ["eval", "backfill"], every=False).select("id", F.array_join("tags", ",").alias("tags"))


@query("SELECT id, ttl, status.status AS status FROM batch_jobs")
def jobs_without_spec(spark, d):
    return _jobs(spark, d).drop("spec").select("id", "ttl", F.col("status.status").alias("status"))


_LATEST = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"


@query(_LATEST)
def latest_status(spark, d):
    return status.latest(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(f"SELECT c.c_custkey AS custkey, coalesce(l.event_type, c.c_mktsegment) AS state FROM customer c LEFT JOIN ({_LATEST}) l ON c.c_custkey = l.user_id")
def live_over_stored(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("state"))
    live = status.latest(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select(F.col("user_id").alias("custkey"), F.col("event_type").alias("state"))
    return status.overlay(stored, live, "custkey", "state")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def status_deleted(spark, d):
    gone = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))
    return status.without(table(spark, d, "events"), gone, "user_id").select("event_id", "user_id")


_NEW = "SELECT id, arg_max(CAST(enqueue_seq AS BIGINT), enqueue_seq) AS ttl FROM job_queue WHERE id IS NOT NULL GROUP BY id"


@query(f"WITH n AS ({_NEW}) SELECT id, ttl FROM batch_jobs WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, ttl FROM n")
def jobs_upserted(spark, d):
    new = status.latest(_queue(spark, d).where("id is not null"), "id", "enqueue_seq", ["enqueue_seq"]).withColumnRenamed("enqueue_seq", "ttl")
    return store.upsert(_jobs(spark, d).select("id", "ttl"), new)


_PATCH = "SELECT id, arg_max(delivery_batch, enqueue_seq) AS model FROM job_queue WHERE id IS NOT NULL GROUP BY id"


@query(f"WITH p AS ({_PATCH}) SELECT j.id, coalesce(nullif(p.model, ''), j.status.model) AS model FROM batch_jobs j LEFT JOIN p ON j.id = p.id")
def jobs_patched(spark, d):
    patches = status.latest(_queue(spark, d).where("id is not null"), "id", "delivery_batch", ["enqueue_seq"]).withColumnRenamed("delivery_batch", "model")
    return store.patch(_jobs(spark, d).select("id", F.col("status.model").alias("model")), patches, ["model"])[0]


@query(f"WITH p AS ({_PATCH}) SELECT p.id FROM p WHERE p.id NOT IN (SELECT id FROM batch_jobs)")
def patches_without_job(spark, d):
    patches = status.latest(_queue(spark, d).where("id is not null"), "id", "delivery_batch", ["enqueue_seq"]).withColumnRenamed("delivery_batch", "model")
    return store.patch(_jobs(spark, d).select("id", F.col("status.model").alias("model")), patches, ["model"])[1]


@query("SELECT id, min(enqueue_seq) AS place FROM job_queue WHERE id IN (SELECT id FROM batch_jobs) GROUP BY id")
def jobs_deleted(spark, d):
    ids = _queue(spark, d).select("id", F.col("enqueue_seq").alias("place"))
    return store.delete(_jobs(spark, d).select("id"), ids)[1]


@query("SELECT id FROM batch_jobs WHERE id NOT IN (SELECT id FROM job_queue WHERE id IS NOT NULL)")
def jobs_left_after_delete(spark, d):
    return store.delete(_jobs(spark, d).select("id"), _queue(spark, d).select("id", F.col("enqueue_seq").alias("place")))[0]


@query("""
SELECT id, enqueue_seq, epoch_us(slo) AS slo FROM job_queue UNION ALL
SELECT id, row_number() OVER (ORDER BY spec.created_at NULLS FIRST, id) + (SELECT max(enqueue_seq) FROM job_queue), epoch_us(slo) FROM batch_jobs""")
def jobs_enqueued(spark, d):
    old = _queue(spark, d).select("id", "enqueue_seq", F.unix_micros("slo").alias("slo"))
    new = _jobs(spark, d).select("id", F.unix_micros("slo").alias("slo"), F.struct("spec.created_at", "id").alias("arrival"))
    return queue.enqueue(old, new)


_REMOVED = "SELECT enqueue_seq FROM (SELECT enqueue_seq, row_number() OVER (PARTITION BY id ORDER BY slo NULLS LAST, enqueue_seq) AS r FROM job_queue WHERE id IN (SELECT id FROM batch_jobs WHERE status.status = 'cancelled')) WHERE r = 1"


@query(f"SELECT enqueue_seq, id FROM job_queue WHERE enqueue_seq NOT IN ({_REMOVED})")
def queue_after_removal(spark, d):
    ids = _jobs(spark, d).where("status.status = 'cancelled'").select("id")
    return queue.remove_first(_queue(spark, d).select("id", "enqueue_seq", "slo"), ids)[0].select("enqueue_seq", "id")


@query("SELECT id, enqueue_seq, epoch_us(slo) AS slo FROM job_queue ORDER BY job_queue.slo NULLS LAST, enqueue_seq LIMIT 100")
def dequeue_topk(spark, d):
    return queue.dequeue(_queue(spark, d), 100)[0].select("id", "enqueue_seq", F.unix_micros("slo").alias("slo"))


@query("SELECT enqueue_seq FROM (SELECT enqueue_seq, row_number() OVER (ORDER BY slo NULLS LAST, enqueue_seq) AS r FROM job_queue) WHERE r > 100")
def dequeue_rest(spark, d):
    return queue.dequeue(_queue(spark, d), 100)[1].select("enqueue_seq")


@query("""
SELECT j.status.model AS model, q.enqueue_seq, CAST(row_number() OVER (PARTITION BY j.status.model ORDER BY q.slo NULLS LAST, q.enqueue_seq) AS INTEGER) AS turn
FROM job_queue q JOIN batch_jobs j ON q.id = j.id QUALIFY turn <= 5""")
def dequeue_per_model(spark, d):
    jobs = _jobs(spark, d).select("id", F.col("status.model").alias("model"))
    return queue.dequeue_each(_queue(spark, d).join(jobs, "id"), "model", 5).select("model", "enqueue_seq", "turn")


@query("SELECT q.enqueue_seq, j.id, j.status.status AS status FROM job_queue q JOIN batch_jobs j ON q.id = j.id")
def queue_with_jobs(spark, d):
    return _queue(spark, d).join(_jobs(spark, d).select("id", F.col("status.status").alias("status")), "id").select("enqueue_seq", "id", "status")


@query("SELECT enqueue_seq FROM job_queue q WHERE NOT EXISTS (SELECT 1 FROM batch_jobs j WHERE j.id = q.id)")
def queue_without_job(spark, d):
    return _queue(spark, d).join(_jobs(spark, d).select("id"), "id", "left_anti").select("enqueue_seq")


_SUBSCRIPTIONS = "SELECT s_suppkey AS user_id, s_name AS channel FROM supplier UNION ALL SELECT s_suppkey, 'spare' FROM supplier WHERE s_acctbal > 5000"


def _subscriptions(spark, d):
    rows = table(spark, d, "supplier")
    return rows.select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("channel")).unionByName(rows.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("user_id"), F.lit("spare").alias("channel")))


@query(f"SELECT e.event_id, s.channel FROM events e JOIN ({_SUBSCRIPTIONS}) s USING (user_id)")
def event_fan_out(spark, d):
    return events.fan_out(table(spark, d, "events"), _subscriptions(spark, d), "user_id").select("event_id", "channel")


@query(f"SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM ({_SUBSCRIPTIONS}))")
def events_sent(spark, d):
    return events.sent(table(spark, d, "events"), _subscriptions(spark, d), "user_id").select("event_id")


_KIND = "CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END"


@query(f"SELECT c_custkey AS id FROM customer LEFT JOIN (SELECT user_id, arg_max({_KIND}, (ts, event_id)) AS k FROM events GROUP BY user_id) ON c_custkey = user_id WHERE k IS NULL OR k = 2")
def runnable_jobs(spark, d):
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    control = table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.expr(_KIND).alias("type"))
    return events.runnable(jobs, control, ["ts", "event_id"])


@query("SELECT id FROM batch_jobs WHERE ttl IS NULL OR ttl <= 0 OR spec.created_at + ttl > 1745000000")
def jobs_alive(spark, d):
    return _jobs(spark, d).where(status.alive(F.col("spec.created_at"), F.col("ttl"), F.lit(1745000000))).select("id")


@query("SELECT id FROM batch_jobs WHERE epoch_us(slo) < 1743500000000000 AND coalesce(status.status NOT IN ('completed', 'failed', 'expired', 'cancelled'), true)")
def jobs_past_deadline(spark, d):
    return _jobs(spark, d).where(status.missed(F.col("slo"), F.col("status.status"), F.timestamp_micros(F.lit(1743500000000000)))).select("id")


@query("""
SELECT id, spec.endpoint AS endpoint, spec.input_file_id AS input_file_id, spec.created_at AS created_at, status.status AS status, status.request_counts.total AS total,
  len(status.errors.data) AS errors FROM batch_jobs""")
def job_as_batch(spark, d):
    flat = codec.flatten(_jobs(spark, d))
    return flat.select("id", "endpoint", "input_file_id", "created_at", "status", F.col("request_counts.total").alias("total"), F.size("errors.data").cast("bigint").alias("errors"))


@query("SELECT id, spec.endpoint AS endpoint, spec.created_at AS created_at, status.status AS status, status.expires_at AS expires_at FROM batch_jobs WHERE spec IS NOT NULL AND status IS NOT NULL")
def job_json_round_trip(spark, d):
    written = _jobs(spark, d).select("id", F.to_json("spec").alias("spec"), F.to_json("status").alias("status"))
    return codec.jobs_as_batches(written).select("id", "endpoint", "created_at", "status", "expires_at")


_UNITS = "CASE regexp_extract(x, '[a-zµμ]+$') WHEN 'ns' THEN 1e-9 WHEN 'us' THEN 1e-6 WHEN 'µs' THEN 1e-6 WHEN 'μs' THEN 1e-6 WHEN 'ms' THEN 1e-3 WHEN 's' THEN 1 WHEN 'm' THEN 60 ELSE 3600 END"
_TOKENS = "regexp_extract_all(w, '(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:ns|us|µs|μs|ms|s|m|h)')"
_WINDOW = f"CAST(trunc(sign * coalesce(list_sum(list_transform({_TOKENS}, lambda x: CAST('0' || rtrim(regexp_extract(x, '^[0-9.]+'), '.') AS DOUBLE) * {_UNITS})), 0)) AS BIGINT)"
_DURATION = "regexp_full_match(w, '[-+]?(0|(([0-9]+[.]?[0-9]*|[.][0-9]+)(ns|us|µs|μs|ms|s|m|h))+)')"


@query(f"SELECT id, CASE WHEN {_DURATION} THEN {_WINDOW} END AS seconds FROM (SELECT id, spec.completion_window AS w, CASE WHEN spec.completion_window LIKE '-%' THEN -1 ELSE 1 END AS sign FROM batch_jobs)")
def completion_window_seconds(spark, d):
    return _jobs(spark, d).select("id", scalars.duration_seconds(F.col("spec.completion_window")).cast("bigint").alias("seconds"))


_ODD = "CASE o_orderkey % 9 WHEN 0 THEN n || '.5h' WHEN 1 THEN '-' || n || 'm.25s' WHEN 2 THEN n || 'ms' WHEN 3 THEN '+' || n || '.h1m' WHEN 4 THEN n || 'd' WHEN 5 THEN n || ' h' WHEN 6 THEN '0' WHEN 7 THEN n || 'us' || n || 'µs' ELSE '' END"


@query(f"SELECT o_orderkey, CASE WHEN {_DURATION} THEN {_WINDOW} END AS seconds FROM (SELECT o_orderkey, {_ODD} AS w, CASE WHEN {_ODD} LIKE '-%' THEN -1 ELSE 1 END AS sign FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS n FROM orders))")
def odd_durations(spark, d):
    """Durations of every unit, with fractions and signs, and texts that are none."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("n")).select("o_orderkey", F.expr(_ODD).alias("w"))
    return rows.select("o_orderkey", scalars.duration_seconds(F.col("w")).cast("bigint").alias("seconds"))


@query(f"SELECT id, (created_at + {_WINDOW}) * 1000000 AS slo FROM (SELECT id, spec.created_at AS created_at, spec.completion_window AS w, CASE WHEN spec.completion_window LIKE '-%' THEN -1 ELSE 1 END AS sign FROM batch_jobs) WHERE {_DURATION}")
def slo_of_jobs(spark, d):
    rows = _jobs(spark, d).where(scalars.is_duration(F.col("spec.completion_window")))
    return rows.select("id", F.unix_micros(codec.slo(F.col("spec.created_at"), F.col("spec.completion_window"))).alias("slo"))


@query("""
SELECT o_orderkey AS n, CASE o_orderkey % 600 WHEN 400 THEN 'BadRequestError' WHEN 401 THEN 'AuthenticationError' WHEN 403 THEN 'PermissionDeniedError' WHEN 404 THEN 'NotFoundError'
  WHEN 422 THEN 'UnprocessableEntityError' WHEN 429 THEN 'RateLimitError' WHEN 501 THEN 'NotImplementedError' ELSE CASE WHEN o_orderkey % 600 >= 500 THEN 'InternalServerError' ELSE 'APIConnectionError' END END AS type FROM orders""")
def error_code_to_type(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), scalars.error_code_to_type(F.col("o_orderkey") % 600).alias("type"))


@query("SELECT id, CASE WHEN n < 100 THEN '100' WHEN n < 1000 THEN '1000' WHEN n < 10000 THEN '10000' WHEN n < 30000 THEN '30000' WHEN n IS NOT NULL THEN 'large' END AS bucket FROM (SELECT id, result_metadata.total AS n FROM batch_jobs)")
def size_bucket(spark, d):
    return _jobs(spark, d).select("id", scalars.size_bucket(F.col("result_metadata.total")).alias("bucket"))


@query("SELECT row_seq, CASE status WHEN 0 THEN 'OK' WHEN 1 THEN 'ERROR' END AS status FROM requests")
def request_status_names(spark, d):
    return _requests(spark, d).select("row_seq", scalars.request_status_name(F.col("status")).alias("status"))


@query("""
SELECT id, CASE WHEN coalesce(w, '') = '' THEN 'completion_window is required' WHEN NOT regexp_full_match(w, '[-+]?(0|((\\d+\\.?\\d*|\\.\\d+)(ns|us|ms|s|m|h))+)') THEN 'completion_window must be a valid duration (e.g., 24h)'
  WHEN coalesce(e, '') = '' THEN 'endpoint is required' WHEN e NOT IN ('/v1/responses', '/v1/chat/completions', '/v1/embeddings', '/v1/completions', '/v1/moderations') THEN 'invalid endpoint: ' || e
  WHEN coalesce(f, '') = '' THEN 'input_file_id is required' WHEN x IS NOT NULL AND x % 7 = 0 THEN 'output_expires_after.anchor is required'
  WHEN x NOT BETWEEN 3600 AND 2592000 THEN 'output_expires_after.seconds must be between 3600 (1 hour) and 2592000 (30 days)' END AS error
FROM (SELECT id, spec.completion_window AS w, spec.endpoint AS e, spec.input_file_id AS f, CASE WHEN spec.created_at % 3 > 0 THEN spec.created_at % 4000 * 800 END AS x FROM batch_jobs)""")
def validate_create_batch(spark, d):
    seconds = F.col("spec.created_at") % 4000 * 800
    expiry = F.when(F.col("spec.created_at") % 3 > 0, F.struct(seconds.alias("seconds"), F.when(seconds % 7 == 0, "").otherwise("created_at").alias("anchor")))
    return _jobs(spark, d).select("id", checks.batch_request_error(F.col("spec.completion_window"), F.col("spec.endpoint"), F.col("spec.input_file_id"), expiry).alias("error"))


@query("SELECT enqueue_seq, CASE WHEN coalesce(id, '') = '' THEN 'ID is empty' WHEN slo IS NULL THEN 'SLO is zero for ID ' || id WHEN coalesce(j.ttl, 0) % 11 <= 0 THEN 'TTL is invalid for ID ' || id END AS error FROM job_queue LEFT JOIN (SELECT id, ttl FROM batch_jobs) j USING (id)")
def queue_entry_errors(spark, d):
    rows = _queue(spark, d).join(_jobs(spark, d).select("id", "ttl"), "id", "left")
    return rows.select("enqueue_seq", checks.job_error(F.col("id"), F.col("slo"), F.col("ttl") % 11).alias("error"))


@query("SELECT id, result_metadata.succeeded + result_metadata.failed = result_metadata.total AS agrees FROM batch_jobs")
def tallies_agree(spark, d):
    r = "result_metadata."
    return _jobs(spark, d).select("id", checks.tallies_agree(F.col(r + "total"), F.col(r + "succeeded"), F.col(r + "failed")).alias("agrees"))


@query("SELECT status.status AS status, coalesce(status.status IN ('completed', 'failed', 'expired', 'cancelled'), false) AS final, count(*) AS jobs FROM batch_jobs GROUP BY ALL")
def final_states(spark, d):
    s = F.col("status.status")
    return _jobs(spark, d).groupBy(s.alias("status"), F.coalesce(checks.is_final(s), F.lit(False)).alias("final")).agg(F.count(F.lit(1)).alias("jobs"))


_LEADING = "TRY_CAST(nullif(regexp_extract(t, '^\\s*([-+]?[0-9]+)', 1), '') AS BIGINT)"


@query(f"SELECT p_partkey AS n, CASE WHEN t = '' THEN 20 WHEN {_LEADING} BETWEEN 1 AND 100 THEN {_LEADING} END AS page_limit, CASE WHEN t = '' THEN 0 WHEN {_LEADING} >= 0 THEN {_LEADING} END AS page_start FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN p_name ELSE CAST(p_partkey % 211 - 20 AS VARCHAR) || p_brand END AS t FROM part)")
def paging_texts(spark, d):
    text = F.expr("CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN p_name ELSE CAST(p_partkey % 211 - 20 AS STRING) || p_brand END")
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), checks.page_limit(text).alias("page_limit"), checks.page_start(text).alias("page_start"))


@query("SELECT job_id, count(*) AS requests, CAST(sum(coalesce(strlen(request_body), 0)) AS BIGINT) AS bytes FROM requests WHERE job_id IS NOT NULL GROUP BY job_id HAVING count(*) > 100 OR bytes > 20000")
def oversize_jobs(spark, d):
    return checks.oversize_jobs(_requests(spark, d), "job_id", "request_body", 100, 20000)


@query("""
SELECT row_seq, CASE WHEN coalesce(request_id, '') = '' THEN 'request_id is required' WHEN coalesce(end_point, '') = '' THEN 'end_point is required'
  WHEN end_point NOT IN ('/v1/responses', '/v1/chat/completions', '/v1/embeddings', '/v1/completions', '/v1/moderations') THEN 'invalid end_point: ' || end_point
  WHEN coalesce(model, '') = '' THEN 'model is required' WHEN request_body IS NULL THEN 'request_body is required' END AS error FROM requests""")
def request_line_errors(spark, d):
    return _requests(spark, d).select("row_seq", checks.line_error(F.col("request_id"), F.col("model"), F.col("end_point"), F.col("request_body")).alias("error"))


@query("SELECT row_seq, model, CASE WHEN json_valid(request_body) THEN request_body ->> '$.model' END AS body_model, CASE WHEN json_valid(request_body) THEN TRY_CAST(request_body ->> '$.max_tokens' AS BIGINT) END AS max_tokens FROM requests")
def request_parameters(spark, d):
    params = process.parameters(_requests(spark, d).select(F.col("row_seq").cast("string").alias("request_id"), "model", "request_body"))
    return params.select(F.col("request_id").cast("bigint").alias("row_seq"), "model", F.expr("try_variant_get(params, '$.model', 'string')").alias("body_model"), F.expr("try_variant_get(params, '$.max_tokens', 'bigint')").alias("max_tokens"))


@query("SELECT r.row_seq, coalesce(CASE WHEN json_valid(request_body) THEN TRY_CAST(request_body ->> '$.max_tokens' AS BIGINT) END, m.most, CASE r.end_point WHEN '/v1/embeddings' THEN 64 WHEN '/v1/responses' THEN 512 END, 256) AS max_tokens FROM requests r LEFT JOIN (SELECT model, count(*) AS most FROM requests WHERE status = 1 GROUP BY model HAVING count(*) % 2 = 0) m ON r.model = m.model")
def parameter_defaults(spark, d):
    rows = _requests(spark, d)
    by_model = metrics.counter(rows.where("status = 1"), "model").where("value % 2 = 0").select("model", F.col("value").alias("most"))
    by_api = F.when(F.col("end_point") == "/v1/embeddings", 64).when(F.col("end_point") == "/v1/responses", 512).cast("bigint")
    own = F.expr("try_variant_get(try_parse_json(request_body), '$.max_tokens', 'bigint')")
    return rows.join(by_model, "model", "left").select("row_seq", process.with_defaults(own, F.col("most"), by_api, F.lit(256).cast("bigint")).alias("max_tokens"))


@query("SELECT q.request_id, r.request_id IS NOT NULL AS answered FROM inference_requests q LEFT JOIN inference_responses r ON q.request_id = r.request_id")
def requests_with_answers(spark, d):
    got = table(spark, d, "inference_responses").select("request_id", "response")
    return process.answers(table(spark, d, "inference_requests"), got, ["request_id"]).select("request_id", F.col("response").isNotNull().alias("answered"))


@query("SELECT request_id FROM inference_requests WHERE request_id NOT IN (SELECT request_id FROM inference_responses WHERE request_id IS NOT NULL)")
def requests_remaining(spark, d):
    return process.remaining(table(spark, d, "inference_requests"), table(spark, d, "inference_responses"), ["request_id"]).select("request_id")


@query("SELECT s.s_suppkey AS model, n.n_name AS pool, r.r_name AS region FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def models_to_pools(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    pools = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(pools, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("model"), F.col("n_name").alias("pool"), F.col("r_name").alias("region"))


@query("SELECT job_id, count(*) AS total, count(*) FILTER (status <> 1) AS succeeded, count(*) FILTER (status = 1) AS failed FROM requests WHERE job_id IS NOT NULL GROUP BY job_id")
def job_outcome_tally(spark, d):
    return process.tally(_requests(spark, d).where("job_id is not null"), F.col("status") == 1)


@query("SELECT id, CASE WHEN t > 0 THEN round((c + f) / t, 6) END AS progress FROM (SELECT id, status.request_counts.total AS t, status.request_counts.completed AS c, status.request_counts.failed AS f FROM batch_jobs)")
def job_progress(spark, d):
    c = "status.request_counts."
    return _jobs(spark, d).select("id", F.round(process.progress(F.col(c + "total"), F.col(c + "completed"), F.col(c + "failed")), 6).alias("progress"))


@query("SELECT end_point, status, count(*) AS value FROM requests GROUP BY ALL")
def counter_by_outcome(spark, d):
    return metrics.counter(_requests(spark, d), "end_point", "status")


@query("SELECT model, count(*) AS value FROM requests WHERE status = 1 GROUP BY model")
def errors_by_model(spark, d):
    return metrics.counter(_requests(spark, d).where("status = 1"), "model")


def _histogram_sql(rows: str, bounds: list[float], labels: str) -> str:
    le = " UNION ALL ".join(f"SELECT {b!r}::DOUBLE AS le" for b in bounds) + " UNION ALL SELECT 'infinity'::DOUBLE"
    return f"WITH v AS ({rows}), b AS ({le}) SELECT {labels}, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(round(le * 1000) AS BIGINT)::VARCHAR END AS le_ms, count(*) FILTER (v <= le) AS bucket_count, round(sum(v), 3) AS sum, count(*) AS count FROM v, b WHERE v IS NOT NULL GROUP BY {labels}, le"


def _le(rows: DataFrame) -> DataFrame:
    ms = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.round(F.col("le") * 1000).cast("bigint").cast("string"))
    return rows.withColumn("le_ms", ms).withColumn("sum", F.round("sum", 3)).drop("le")


@query(_histogram_sql("SELECT status.model AS model, CAST(status.completed_at - status.in_progress_at AS DOUBLE) AS v FROM batch_jobs", metrics.exponential_bounds(*metrics.DURATION_BOUNDS), "model"))
def duration_histogram(spark, d):
    rows = _jobs(spark, d).select(F.col("status.model").alias("model"), (F.col("status.completed_at") - F.col("status.in_progress_at")).cast("double").alias("v"))
    return _le(metrics.histogram(rows, "v", metrics.exponential_bounds(*metrics.DURATION_BOUNDS), "model"))


@query(_histogram_sql("SELECT end_point, (epoch_us(delivered_at) - epoch_us(sent_at)) / 1000000.0 AS v FROM requests", metrics.exponential_bounds(*metrics.WAIT_BOUNDS), "end_point"))
def queue_wait_histogram(spark, d):
    rows = _requests(spark, d).select("end_point", ((F.unix_micros("delivered_at") - F.unix_micros("sent_at")) / F.lit(1000000.0)).alias("v"))
    return _le(metrics.histogram(rows, "v", metrics.exponential_bounds(*metrics.WAIT_BOUNDS), "end_point"))


@query(_histogram_sql("SELECT event_type, value / 100 AS v FROM events", list(metrics.HTTP_BOUNDS), "event_type"))
def http_duration_histogram(spark, d):
    return _le(metrics.histogram(table(spark, d, "events").select("event_type", (F.col("value") / 100).alias("v")), "v", list(metrics.HTTP_BOUNDS), "event_type"))


@query("""
WITH x AS (SELECT id, status.model AS model, status.in_progress_at AS moment, 1 AS delta FROM batch_jobs WHERE status.in_progress_at IS NOT NULL
  UNION ALL SELECT id, status.model, status.completed_at, -1 FROM batch_jobs WHERE status.completed_at IS NOT NULL)
SELECT id, model, moment, CAST(sum(delta) OVER (PARTITION BY model ORDER BY moment, delta, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM x""")
def active_jobs_gauge(spark, d):
    jobs = _jobs(spark, d).select("id", "status.model", "status.in_progress_at", "status.completed_at")
    start = jobs.where("in_progress_at is not null").select("id", "model", F.col("in_progress_at").alias("moment"), F.lit(1).alias("delta"))
    end = jobs.where("completed_at is not null").select("id", "model", F.col("completed_at").alias("moment"), F.lit(-1).alias("delta"))
    return metrics.gauge(start.unionByName(end), "delta", ["moment", "delta", "id"], "model").select("id", "model", "moment", "value")


@query("""
SELECT request_id, coalesce(TRY_CAST(response ->> '$.usage.input_tokens' AS BIGINT), TRY_CAST(response ->> '$.usage.prompt_tokens' AS BIGINT)) AS input_tokens,
  coalesce(TRY_CAST(response ->> '$.usage.input_tokens_details.cached_tokens' AS BIGINT), TRY_CAST(response ->> '$.usage.prompt_tokens_details.cached_tokens' AS BIGINT)) AS cached_tokens,
  coalesce(TRY_CAST(response ->> '$.usage.output_tokens' AS BIGINT), TRY_CAST(response ->> '$.usage.completion_tokens' AS BIGINT)) AS output_tokens,
  coalesce(TRY_CAST(response ->> '$.usage.output_tokens_details.reasoning_tokens' AS BIGINT), TRY_CAST(response ->> '$.usage.completion_tokens_details.reasoning_tokens' AS BIGINT)) AS reasoning_tokens,
  TRY_CAST(response ->> '$.usage.total_tokens' AS BIGINT) AS total_tokens FROM inference_responses""")
def token_usage(spark, d):
    return process.usage(table(spark, d, "inference_responses")).drop("response", "received_at")


@query("""
SELECT model, CAST(sum(status_usage.input_tokens) AS BIGINT) AS input_tokens, CAST(sum(status_usage.output_tokens) AS BIGINT) AS output_tokens, CAST(sum(status_usage.total_tokens) AS BIGINT) AS total_tokens
FROM (SELECT status.model AS model, status.usage AS status_usage FROM batch_jobs) GROUP BY model""")
def usage_by_model(spark, d):
    u = "status.usage."
    return _jobs(spark, d).groupBy(F.col("status.model").alias("model")).agg(*[F.sum(u + c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])


@query("""
SELECT job_id, (r - 1) // 1000 AS chunk, string_agg(concat_ws(':', line, row_seq, end_point), ';' ORDER BY r) AS errors
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY line NULLS FIRST, row_seq) AS r FROM requests WHERE status = 1) GROUP BY job_id, chunk""")
def job_error_lists(spark, d):
    failed = _requests(spark, d).where("status = 1")
    listed = process.error_list(failed.select("job_id", "line", F.col("row_seq").alias("code"), F.col("end_point").alias("message"), F.lit(None).cast("string").alias("param")))
    return listed.select("job_id", "chunk", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["line"], e["code"], e["message"])), ";").alias("errors"))


@query("""
SELECT row_seq FROM (SELECT row_seq, coalesce(sum(CASE WHEN status = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY line, row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM requests WHERE job_id IS NOT NULL) WHERE spent <= 10""")
def stop_at_threshold(spark, d):
    lines = _requests(spark, d).select("row_seq", "job_id", "line", "status").where("job_id is not null")
    return process.until_threshold(lines, "job_id", ["line", "row_seq"], F.when(F.col("status") == 1, 1).otherwise(0), 10).select("row_seq")


@query("SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 3")
def over_rate_limit(spark, d):
    rows = process.over_rate(table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "1 day", 3)
    return rows.select("user_id", F.unix_timestamp("period_start").alias("day"), "n")


@query("""
WITH c AS (SELECT label, list(avg_v ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS avg_v FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
SELECT vec_id, arg_min(label, (dist, label)) AS label FROM (SELECT e.vec_id, c.label, list_sum(list_transform(generate_series(1, len(c.v)), lambda k: (CAST(e.embedding[k] AS DOUBLE) - c.v[k]) ** 2)) AS dist FROM embeddings e, c) GROUP BY vec_id""")
def group_by_centroid(spark, d):
    vectors = table(spark, d, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroids = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    return process.nearest_centroid(vectors, centroids, "vec_id", "embedding", "label").select("vec_id", "label")


@query("SELECT model, end_point, count(*) AS n FROM requests GROUP BY ALL")
def requests_grouped(spark, d):
    return process.grouped(_requests(spark, d).select("model", "end_point"), "model", "end_point").groupBy("model", "end_point").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'requests_total{' || CASE WHEN end_point IS NULL THEN '' ELSE 'end_point=\"' || end_point || '\",' END || 'status=\"' || status || '\"} ' || count(*) AS line FROM requests GROUP BY end_point, status")
def metrics_text(spark, d):
    counted = metrics.counter(_requests(spark, d), "end_point", "status")
    return metrics.exposition(counted, "requests_total", "value", "end_point", "status")


def _echo():
    def answer(request_id: str, model: str, body: str) -> str:
        if body is None:
            raise process.InferenceError("INVALID_REQ", "no body")
        if model is None:
            raise ValueError("no model")
        return f"{model}:{len(body)}"

    return answer


@query("""
SELECT CAST(row_seq AS VARCHAR) AS request_id, CASE WHEN request_body IS NOT NULL THEN model || ':' || length(request_body) END AS response,
  CASE WHEN request_body IS NULL THEN 'INVALID_REQ' WHEN model IS NULL THEN 'UNKNOWN' END AS category FROM requests""")
def inference_step(spark, d):
    lines = _requests(spark, d).select(F.col("row_seq").cast("string").alias("request_id"), "job_id", "model", "request_body")
    return process.run_lines(lines, _echo, 8).select("request_id", "response", "category")


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN request_body IS NULL THEN 'INVALID_REQ' ELSE 'UNKNOWN' END AS category FROM requests WHERE request_body IS NULL OR model IS NULL) GROUP BY category")
def inference_errors(spark, d):
    lines = _requests(spark, d).select(F.col("row_seq").cast("string").alias("request_id"), "job_id", "model", "request_body")
    return process.split_results(process.run_lines(lines, _echo, 8))[1].groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_ASKED = f"""SELECT id, spec.completion_window AS w, {_WINDOW.replace("sign *", "CASE WHEN w LIKE '-%' THEN -1 ELSE 1 END *")} AS seconds, spec.created_at AS made, spec.endpoint AS e, spec.input_file_id AS f,
  CASE WHEN ttl % 2 = 0 THEN 3600 + ttl % 1000 END AS x, CASE WHEN status.model LIKE 'q%' THEN 'later' ELSE 'created_at' END AS anchor FROM batch_jobs WHERE spec IS NOT NULL"""
_SOUND = _DURATION + " AND e IN ('/v1/responses', '/v1/chat/completions', '/v1/embeddings', '/v1/completions', '/v1/moderations') AND coalesce(f, '') <> ''"


def _created(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    expiry = F.when(F.col("ttl") % 2 == 0, F.struct((3600 + F.col("ttl") % 1000).alias("seconds"), F.when(F.col("status.model").like("q%"), "later").otherwise("created_at").alias("anchor")))
    asked = _jobs(spark, d).where("spec is not null").select("id", "spec.input_file_id", "spec.endpoint", "spec.completion_window", "spec.metadata", "spec.created_at", expiry.alias("output_expires_after"))
    return codec.create(asked, F.col("id"), F.col("created_at"))


@query(f"""
SELECT 'batch_' || id AS id, (made + seconds) * 1000000 AS slo, CASE WHEN x IS NOT NULL AND anchor = 'created_at' THEN seconds + x ELSE 2592000 END AS ttl, 'validating' AS status
FROM ({_ASKED}) WHERE {_SOUND}""")
def jobs_created(spark, d):
    return _created(spark, d)[0].select("id", F.unix_micros("slo").alias("slo"), "ttl", "status.status")


@query(f"SELECT id FROM ({_ASKED}) WHERE NOT coalesce({_SOUND}, false)")
def job_requests_rejected(spark, d):
    return _created(spark, d)[1].select("id")


@query("SELECT DISTINCT id, 'not found: ' || coalesce(id, '') AS message FROM job_queue q WHERE NOT EXISTS (SELECT 1 FROM batch_jobs j WHERE j.id = q.id)")
def lookup_missing(spark, d):
    return store.not_found(_jobs(spark, d).select("id"), _queue(spark, d).select("id"))


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN 'NotFoundError' ELSE 'InternalServerError' END AS type FROM orders")
def api_error_types(spark, d):
    given = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), scalars.error_type(F.when(F.col("o_orderkey") % 2 == 0, 404).otherwise(503), given).alias("type"))


@query("SELECT row_seq, coalesce(nullif(request_id, ''), 'row-' || row_seq) AS request_id, CASE WHEN status = 0 THEN 'and' ELSE 'or' END AS condition FROM requests WHERE end_point NOT IN ('/metrics', '/health')")
def request_identifiers(spark, d):
    rows = _requests(spark, d).where(checks.observed(F.col("end_point")))
    return rows.select("row_seq", scalars.identifier(F.col("request_id"), F.concat(F.lit("row-"), F.col("row_seq").cast("string"))).alias("request_id"), scalars.tag_condition_name(F.col("status") + 1).alias("condition"))


def _run_stream(spark: SparkSession, rows: DataFrame, mode: str, one_batch: bool = False) -> DataFrame:
    """What a streaming query has put out once it has read all there is; its folders are removed.

    State with processing-time timers asks for batch after batch, so it is run for one only.
    """
    place = own_folder(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/out")

    writer = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state")
    (writer.trigger(once=True) if one_batch else writer.trigger(availableNow=True)).start().awaitTermination()
    out = cut(spark.read.parquet(f"{place}/out"))
    remove(spark, place)
    return out


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return live.read_stream(spark, f"{d}/event[s].parquet", spark.read.parquet(f"{d}/events.parquet").schema)


@query(_LATEST)
def latest_status_stream(spark, d):
    """The latest status kept by a streaming query over the events file, run to the end of what is there."""
    return _run_stream(spark, live.latest_status(_event_stream(spark, d), "user_id", "event_type", ["ts", "event_id"]), "complete")


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_per_day_stream(spark, d):
    """Counts per day and type kept by a streaming query, in complete mode, so that the open days come out as well."""
    out = _run_stream(spark, live.counts_per_period(_event_stream(spark, d), "ts", "1 day", "1 hour", "event_type"), "complete")
    return out.select(F.unix_timestamp("period_start").alias("day"), "event_type", "n")


@query("SELECT user_id, count(*) AS writes FROM events GROUP BY user_id")
def state_with_ttl(spark, d):
    """Writes per key counted by a stateful operator whose cells run out after a day without a write."""
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = _event_stream(spark, d).select("user_id", "event_type")
        out = _run_stream(spark, live.expiring_state(rows, "user_id", "event_type", 86_400_000), "update", one_batch=True)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept) if kept else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out.groupBy("user_id").agg(F.max("writes").alias("writes"))


@query("SELECT enqueue_seq, id FROM job_queue")
def queue_polled_twice(spark, d):
    """The queue polled in two runs over a growing folder: the second goes on where the first stopped."""
    place = own_folder(spark, "poll")
    entries = _queue(spark, d).select("enqueue_seq", "id")
    for part in (entries.where("enqueue_seq % 2 = 0"), entries.where("enqueue_seq % 2 <> 0")):
        part.write.mode("append").parquet(f"{place}/in")
        stream = live.read_stream(spark, f"{place}/in", entries.schema)
        live.poll(stream, lambda batch, n: batch.write.mode("append").parquet(f"{place}/out"), f"{place}/state", once=True).awaitTermination()
    out = cut(spark.read.parquet(f"{place}/out"))
    remove(spark, place)
    return out


@query("SELECT CAST(row_seq AS VARCHAR) AS request_id, end_point, request_body, true AS numbered FROM requests")
def request_file_round_trip(spark, d):
    """All requests stored as line-wise JSON files, listed, and read back with their line numbers."""
    place = own_folder(spark, "files")
    line = codec.encode(F.col("row_seq").cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.col("end_point").alias("url"), F.col("request_body").alias("body"))
    files.store(_requests(spark, d).select(line.alias("value")), place, 10**15)
    read = cut(files.read_requests(spark, place))
    remove(spark, place)
    # a file's lines are numbered from 1 without gaps
    whole = read.groupBy("location").agg((F.count_distinct("line") == F.max("line")).alias("numbered"))
    return read.join(whole, "location").select("request_id", "end_point", "request_body", "numbered")


@query("SELECT sum(strlen(n_name) + 1)::BIGINT AS bytes, count(*) AS lines, true AS removed, false AS removed_again FROM nation")
def files_stored_and_deleted(spark, d):
    """Lines stored below a limit, listed with their sizes, retrieved and deleted."""
    place = own_folder(spark, "files")
    files.store(table(spark, d, "nation").select(F.col("n_name").alias("value")), place, 100_000)
    sizes = cut(files.list_files(spark, f"{place}/part-*").agg(F.sum("size").alias("bytes")))
    lines = cut(files.retrieve(spark, place)[0].agg(F.count(F.lit(1)).alias("lines")))
    removed, again = files.delete(spark, place), files.delete(spark, place)
    return sizes.withColumn("one", F.lit(1)).join(lines.withColumn("one", F.lit(1)), "one").select("bytes", "lines", F.lit(removed).alias("removed"), F.lit(again).alias("removed_again"))


_FLAKY = "CAST(row_seq % 4 AS INTEGER)"


def _flaky():
    seen: dict[str, int] = {}
    lock = threading.Lock()

    def answer(request_id: str, model: str, body: str) -> str:
        with lock:
            seen[request_id] = seen.get(request_id, 0) + 1
            failed = seen[request_id] <= int(request_id) % 4
        if failed:
            raise process.InferenceError("RATE_LIMIT" if int(request_id) % 8 < 4 else "SERVER_ERROR", "again later")
        return "done"

    return answer


@query(f"""
SELECT CAST(row_seq AS VARCHAR) AS request_id, CASE WHEN {_FLAKY} < 3 THEN 'done' END AS response, CASE WHEN {_FLAKY} = 3 THEN CASE WHEN row_seq % 8 < 4 THEN 'RATE_LIMIT' ELSE 'SERVER_ERROR' END END AS category,
  least({_FLAKY} + 1, 3) AS attempts FROM requests""")
def inference_retried(spark, d):
    """A client that fails up to three times in a way worth another try, at most two of which are made."""
    lines = _requests(spark, d).select(F.col("row_seq").cast("string").alias("request_id"), "job_id", "model", "request_body")
    return process.run_lines(lines, _flaky, 4, retries=2, per_model={"osier-vision": 2}).select("request_id", "response", "category", "attempts")


@query("""
SELECT job_id, CAST(row_seq AS VARCHAR) AS request_id, CASE WHEN request_body IS NOT NULL AND model IS NOT NULL THEN model || ':' || length(request_body) END AS response,
  CASE WHEN request_body IS NULL THEN 'INVALID_REQ' WHEN model IS NULL THEN 'UNKNOWN' END AS category FROM requests""")
def job_result_files(spark, d):
    """Output and error files of every job, written and read back."""
    place = own_folder(spark, "results")
    lines = _requests(spark, d).select(F.col("row_seq").cast("string").alias("request_id"), "job_id", "model", "request_body")
    output, errors = process.write_results(process.run_lines(lines, _echo, 4), place, rows_per_file=2_000)
    schema = "request_id string, response string, category string, message string, attempts int, job_id string"
    read = [spark.read.schema(schema).json(x).select("job_id", "request_id", "response", "category") for x in (output, errors)]
    out = cut(read[0].unionByName(read[1]))
    remove(spark, place)
    return out


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY spec.created_at NULLS FIRST, id) AS n FROM batch_jobs) WHERE n > 60 AND n <= 90")
def list_jobs_by_cursor(spark, d):
    """The third page of thirty jobs, read on from the cursor of the one before."""
    rows, cursor = _jobs(spark, d).select("id", F.col("spec.created_at").alias("created_at")), ""
    for _ in range(2):
        _, cursor = store.page_after(rows, ["created_at", "id"], 30, cursor)
    return store.page_after(rows, ["created_at", "id"], 30, cursor)[0].select("id")


@query("SELECT enqueue_seq, id FROM job_queue ORDER BY delivered_at DESC NULLS LAST, enqueue_seq LIMIT 100")
def dequeue_latest_first(spark, d):
    return queue.dequeue(_queue(spark, d), 100, by=[F.col("delivered_at").desc_nulls_last()])[0].select("enqueue_seq", "id")


@query("""
WITH q AS (SELECT enqueue_seq, id, row_number() OVER (ORDER BY slo NULLS LAST, enqueue_seq) AS r FROM job_queue)
SELECT enqueue_seq, 'taken' AS place FROM q WHERE r <= 200 AND id IN (SELECT id FROM batch_jobs) UNION ALL
SELECT enqueue_seq, 'queued' FROM q WHERE r > 200 OR id IS NULL OR id NOT IN (SELECT id FROM batch_jobs)""")
def queue_put_back(spark, d):
    """Entries without a job go back into the queue they were taken from."""
    taken, rest = queue.dequeue(_queue(spark, d), 200)
    good, back = queue.put_back(rest, taken, _jobs(spark, d))
    return good.select("enqueue_seq", F.lit("taken").alias("place")).unionByName(back.select("enqueue_seq", F.lit("queued").alias("place")))


@query("SELECT id FROM batch_jobs WHERE status.status = 'cancelled' AND id NOT IN (SELECT id FROM job_queue WHERE id IS NOT NULL)")
def queue_removal_misses(spark, d):
    return queue.remove_first(_queue(spark, d).select("id", "enqueue_seq", "slo"), _jobs(spark, d).where("status.status = 'cancelled'").select("id"))[1]


@query("""
SELECT row_seq, CASE WHEN coalesce(request_id, '') = '' THEN 'request_id is required' WHEN coalesce(end_point, '') = '' THEN 'end_point is required'
  WHEN end_point NOT IN ('/v1/chat/completions', '/v1/completions') THEN 'invalid end_point: ' || end_point WHEN coalesce(model, '') = '' THEN 'model is required'
  WHEN model NOT IN ('osier-vision', 'quill-base') THEN 'model is not allowed: ' || model WHEN request_body IS NULL THEN 'request_body is required' END AS error FROM requests""")
def request_lines_allowed(spark, d):
    error = checks.line_error(F.col("request_id"), F.col("model"), F.col("end_point"), F.col("request_body"), ["/v1/chat/completions", "/v1/completions"], ["osier-vision", "quill-base"])
    return _requests(spark, d).select("row_seq", error.alias("error"))


@query("""
WITH x AS (SELECT row_seq, end_point, epoch_us(sent_at) AS moment, 1 AS delta FROM requests WHERE sent_at IS NOT NULL
  UNION ALL SELECT row_seq, end_point, epoch_us(delivered_at), -1 FROM requests WHERE delivered_at IS NOT NULL)
SELECT row_seq, 'POST' AS method, end_point, moment, CAST(sum(delta) OVER (PARTITION BY end_point ORDER BY moment, delta DESC, row_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM x""")
def in_flight_gauge(spark, d):
    """Requests on their way per method and path, after every one that is sent or delivered."""
    rows = _requests(spark, d)
    sent = rows.where("sent_at is not null").select("row_seq", "end_point", F.unix_micros("sent_at").alias("moment"), F.lit(1).alias("delta"))
    got = rows.where("delivered_at is not null").select("row_seq", "end_point", F.unix_micros("delivered_at").alias("moment"), F.lit(-1).alias("delta"))
    moves = sent.unionByName(got).withColumn("method", F.lit("POST")).withColumn("down", -F.col("delta"))
    return metrics.gauge(moves, "delta", ["moment", "down", "row_seq"], "method", "end_point").select("row_seq", "method", "end_point", "moment", "value")


@query(f"""
WITH c AS (SELECT s.channel, row_number() OVER (PARTITION BY s.channel ORDER BY e.event_id) AS r FROM events e JOIN ({_SUBSCRIPTIONS}) s USING (user_id))
SELECT channel, count(*) FILTER (r <= 50) AS kept, count(*) FILTER (r > 50) AS dropped FROM c GROUP BY channel""")
def event_buffer(spark, d):
    """What fits into buffers of fifty events, and how much is dropped."""
    kept, dropped = events.buffered(table(spark, d, "events"), _subscriptions(spark, d), "channel", ["event_id"], 50, "user_id")
    return kept.groupBy("channel").agg(F.count(F.lit(1)).alias("kept")).join(dropped, "channel", "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))


_EVENT = "CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 END"


@query(f"""
SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'ID is empty' WHEN ({_EVENT}) = 3 THEN 'event type 3 is invalid for ID ' || user_id
  WHEN event_type = 'purchase' OR ({_EVENT}) IS NULL THEN NULL WHEN event_id % 5 = 0 THEN 'TTL is invalid for ID ' || user_id END AS error
FROM events WHERE ({_EVENT}) IS NOT NULL""")
def event_errors(spark, d):
    rows = table(spark, d, "events").withColumn("kind", F.expr(_EVENT)).where("kind is not null")
    return rows.select("event_id", checks.event_error(F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string")), F.col("kind"), F.col("event_id") % 5).alias("error"))


@query("SELECT o_orderkey, c, c IN ('RATE_LIMIT', 'SERVER_ERROR') AS again FROM (SELECT o_orderkey, ['RATE_LIMIT', 'SERVER_ERROR', 'INVALID_REQ', 'AUTH_ERROR', 'UNKNOWN'][o_orderkey % 5 + 1] AS c FROM orders)")
def retryable_categories(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("RATE_LIMIT", "SERVER_ERROR", "INVALID_REQ", "AUTH_ERROR", "UNKNOWN")])
    rows = table(spark, d, "orders").select("o_orderkey", F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("c"))
    return rows.withColumn("again", checks.is_retryable(F.col("c")))


_BROKEN = "CASE WHEN ttl % 7 = 0 THEN '' WHEN ttl % 7 = 1 THEN 'null' WHEN ttl % 7 = 2 THEN '{\"endpoint\": ' WHEN ttl % 7 = 3 THEN '[1]'"


@query("SELECT id, CASE WHEN ok THEN spec.endpoint END AS endpoint, CASE WHEN ok THEN spec.input_file_id END AS input_file_id, CASE WHEN ok THEN spec.completion_window END AS completion_window, CASE WHEN ok THEN ttl END AS seconds, ok FROM (SELECT *, spec IS NOT NULL AND coalesce(ttl % 7 > 3, true) AS ok FROM batch_jobs)")
def job_requests_decoded(spark, d):
    """JSON texts of job requests, some of them blank, broken or no object, read with the schema of a request."""
    body = F.to_json(F.struct("spec.endpoint", "spec.input_file_id", "spec.completion_window", F.struct(F.col("ttl").alias("seconds"), F.lit("created_at").alias("anchor")).alias("output_expires_after")))
    texts = _jobs(spark, d).withColumn("whole", F.when(F.col("spec").isNotNull(), body)).select("id", F.expr(f"{_BROKEN} ELSE whole END").alias("body"))
    read = codec.decode(texts, "body", codec.REQUEST, "r")
    return read.select("id", "r.endpoint", "r.input_file_id", "r.completion_window", F.col("r.output_expires_after.seconds").alias("seconds"), F.col("r_ok").alias("ok"))


@query("SELECT id, spec.endpoint AS endpoint FROM batch_jobs WHERE spec IS NOT NULL AND status IS NOT NULL AND coalesce(ttl % 7 > 3, true)")
def unreadable_jobs_skipped(spark, d):
    """Jobs of which either text cannot be read are left out of a list."""
    written = _jobs(spark, d).withColumn("text", F.to_json("spec")).select("id", F.expr(f"{_BROKEN} ELSE text END").alias("spec"), F.to_json("status").alias("status"))
    return codec.jobs_as_batches(written).select("id", "endpoint")


@query("""
SELECT id, strftime(make_timestamp(spec.created_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created, contains(spec.endpoint, 'chat') AS chat, array_to_string(tags[2:], ',') AS rest,
  array_to_string(list_append(coalesce(tags, []), 'seen'), ',') AS more, array_to_string(tags[1:1] || tags[3:], ',') AS without_second FROM batch_jobs""")
def scalar_forms(spark, d):
    """Date text, substring test, slice, append and delete."""
    tags = F.col("tags")
    text = lambda c: F.array_join(c, ",")
    return _jobs(spark, d).select(
        "id", scalars.utc_text(F.col("spec.created_at")).alias("created"), scalars.contains(F.col("spec.endpoint"), F.lit("chat")).alias("chat"), text(F.slice(tags, 2, F.greatest(F.size(tags), F.lit(1)))).alias("rest"),
        text(scalars.with_item(tags, F.lit("seen"))).alias("more"), text(scalars.without_item(tags, F.lit(1))).alias("without_second"),
    )


@query("""
SELECT id, h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || substr('89ab', CAST('0x' || h[17:17] AS INTEGER) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS name_id FROM (SELECT id, md5(id) AS h FROM batch_jobs)""")
def name_uuids(spark, d):
    return _jobs(spark, d).select("id", scalars.name_uuid(F.col("id")).alias("name_id"))


@query("SELECT id FROM batch_jobs WHERE epoch_us(slo) < 1743500000000000 AND (status.in_progress_at IS NULL OR status.in_progress_at * 1000000 > epoch_us(slo))")
def jobs_started_late(spark, d):
    """Deadlines on the start of a job rather than its end."""
    late = status.missed(F.col("slo"), F.col("status.status"), F.timestamp_micros(F.lit(1743500000000000)), F.timestamp_seconds("status.in_progress_at"))
    return _jobs(spark, d).where(late).select("id")


@query("SELECT id FROM batch_jobs WHERE spec.created_at IS NULL OR CAST(make_timestamp(spec.created_at * 1000000) AS DATE) + INTERVAL 2 MONTH > DATE '2025-05-20'")
def jobs_retained(spark, d):
    made = F.date_from_unix_date(F.floor(F.col("spec.created_at") / 86400).cast("int"))
    return _jobs(spark, d).where(status.retained(made, 2, F.lit("2025-05-20").cast("date"))).select("id")


@query("SELECT * FROM (VALUES ('plain', NULL), ('no port', 'port is empty'), ('half a pair', 'certificate and key go together'), ('no such file', '/no/such.crt'), ('unknown name', 'unknown settings: colour')) t(name, error)")
def settings_errors(spark, d):
    """Settings checked one after the other."""
    cases = {"plain": {}, "no port": {"port": ""}, "half a pair": {"ssl_cert_file": "a"}, "no such file": {"ssl_cert_file": "/no/such.crt", "ssl_key_file": "/no/such.key"}, "unknown name": {"colour": "red"}}
    rows = []
    for name, values in cases.items():
        try:
            config.settings(values).check()
            rows.append((name, None))
        except (ValueError, FileNotFoundError) as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "name string, error string")


@query("SELECT n_nationkey AS id, n_name AS name, n_nationkey % 2 = 0 AS updated FROM nation")
def versions_written_and_cleared(spark, d):
    """A table of versions: written twice, read at its pointer, old versions cleared, then closed."""
    place = own_folder(spark, "versions")
    kept = store.Versions(spark, place)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    kept.write(rows.withColumn("updated", F.lit(False)))
    kept.write(kept.read().withColumn("updated", F.col("id") % 2 == 0))
    if kept.clear() != 1:
        raise AssertionError("one old version was there to clear")
    out = cut(kept.read())
    kept.close()
    return out
