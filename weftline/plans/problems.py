"""Queries p1 to p5 of the data-cleaning problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import badrows, nested, orphans, redelivery, skew
from weftline.session import cut
from weftline.sources.tables import table

ORDER = {"requests": ("request_id", ["delivered_at", "row_seq"]), "job_queue": ("id", ["delivered_at", "enqueue_seq"])}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, (key, order) in ORDER.items():
        rows = table(spark, d, name).select(key, *order)
        surplus = redelivery.keep_one(rows, key, order).surplus
        parts.append(surplus.select(F.lit(name).alias("table_name"), F.col(order[1]).alias("row_seq")))
    return parts[0].unionByName(parts[1])


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whole messages, stored ones (the first half of the deliveries by hash) and new ones, one of each."""
    rows = table(spark, d, "requests")
    new = F.pmod(F.xxhash64("delivery_batch"), F.lit(2)) == 1
    return redelivery.deduplicate(rows.where(~new | new.isNull()), rows.where(new), "request_id", ["delivered_at", "row_seq"]).kept.withColumns({c: F.unix_micros(c) for c in ("delivered_at", "sent_at")})


def p1_kept_queue(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows of job_queue, one of each id; rows without an id are all kept."""
    key, order = ORDER["job_queue"]
    return redelivery.keep_one(table(spark, d, "job_queue"), key, order).kept.withColumns({c: F.unix_micros(c) for c in ("delivered_at", "slo")})


def _json_documents(spark: SparkSession, d: str) -> DataFrame:
    asked = nested.documents_of(table(spark, d, "inference_requests"), "request_id", "params", "params")
    return asked.unionByName(nested.documents_of(table(spark, d, "inference_responses"), "request_id", "response", "response"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.array_objects(nested.occurrences(_json_documents(spark, d))).where("NOT again").select(F.col("doc_key").alias("request_id"), "side", "node_path")


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes(nested.occurrences(_json_documents(spark, d), with_content=True))


def p2_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.occurrences(_json_documents(spark, d)).drop("node_id", "parent_id", "again")


#: The flat tables of chat and response bodies: relation, whether its objects stand alone, and their typed fields.
RELATIONS: dict[str, tuple[str, bool, dict[str, str]]] = {
    "messages": ("messages", False, {"role": "role", "content": "content", "tool_call_id": "tool_call_id"}),
    "turns": ("input", False, {"role": "role"}),
    "content_parts": ("content", False, {"type": "type", "text": "text"}),
    "image_urls": ("image_url", True, {"url": "url", "detail": "detail"}),
    "tools": ("tools", False, {"type": "type"}),
    "tool_calls": ("tool_calls", False, {"id": "id", "type": "type"}),
    "functions": ("function", True, {"name": "name", "description": "description", "arguments": "arguments"}),
    "choices": ("choices", False, {"choice bigint": "index", "finish_reason": "finish_reason", "text": "text"}),
    "answers": ("message", True, {"role": "role", "content": "content", "refusal": "refusal"}),
    "outputs": ("output", False, {"type": "type", "role": "role"}),
    "annotations": ("annotations", False, {"type": "type", "url": "url", "start_index bigint": "start_index", "end_index bigint": "end_index"}),
    "top_logprobs": ("top_logprobs", False, {"token": "token", "logprob double": "logprob"}),
    "usage": ("usage", True, {"input_tokens bigint": "input_tokens", "prompt_tokens bigint": "prompt_tokens", "output_tokens bigint": "output_tokens", "completion_tokens bigint": "completion_tokens", "total_tokens bigint": "total_tokens"}),
}


def _relation(name: str):
    relation, single, fields = RELATIONS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        bridge = cut(nested.occurrences(_json_documents(spark, d), with_content=True))
        return nested.relation_table(bridge, nested.nodes(bridge), relation, fields, single).drop("node_id", "parent_id")

    run.__name__ = f"p2_{name}"
    run.__doc__ = f"The flat table of {name}, each row with the path of its parent."
    return run


def p2_logprobs(spark: SparkSession, d: str) -> DataFrame:
    """Log probabilities of the chosen tokens: the parts called content whose parent stands under logprobs."""
    bridge = cut(nested.occurrences(_json_documents(spark, d), with_content=True))
    parts = nested.relation_table(bridge, nested.nodes(bridge), "content", {"token": "token", "logprob double": "logprob"})
    return parts.where(F.col("parent_path").endswith("/logprobs/content")).drop("node_id", "parent_id")


def graph() -> list[orphans.Edge]:
    """The foreign keys of the project's tables; columns are built here, when a session is up."""
    return [
        orphans.Edge("batch_jobs", "input_file_id", "file_objects", F.col("spec.input_file_id"), F.col("id"), F.col("spec.created_at")),
        orphans.Edge("batch_jobs", "output_file_id", "file_objects", F.col("status.output_file_id"), F.col("id"), F.col("status.finalizing_at")),
        orphans.Edge("requests", "job_id", "batch_jobs", F.col("job_id"), F.col("row_seq"), F.unix_timestamp("sent_at")),
        orphans.Edge("job_queue", "id", "batch_jobs", F.col("id"), F.col("enqueue_seq"), F.unix_timestamp("delivered_at")),
        orphans.Edge("raw_lines", "file_id", "file_objects", F.col("file_id"), F.concat_ws(":", "file_id", "line"), F.unix_timestamp("loaded_at")),
        orphans.Edge("inference_requests", "request_id", "requests", F.col("request_id"), F.col("request_id"), F.unix_timestamp("created_at")),
        orphans.Edge("inference_responses", "request_id", "inference_requests", F.col("request_id"), F.col("request_id"), F.unix_timestamp("received_at")),
    ]


def _parents() -> dict[str, orphans.Parent]:
    return {
        "file_objects": orphans.Parent(F.col("id"), F.col("arrived_at"), F.col("deleted_at")),
        "batch_jobs": orphans.Parent(F.col("id")),
        "requests": orphans.Parent(F.col("request_id")),
        "inference_requests": orphans.Parent(F.col("request_id")),
    }


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    edges = graph()
    names = {e.child for e in edges} | {e.parent for e in edges}
    return orphans.cascade({n: table(spark, d, n) for n in sorted(names)}, edges, _parents())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    own = _cascade(spark, d).where((F.col("table_name") == "batch_jobs") & ~F.col("inherited"))
    return own.select(F.col("row_key").alias("job_id"), F.col("field").alias("ref_field"), "orphan_kind").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(_cascade(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.parse_records(table(spark, d, "raw_lines")).where(F.col("reason").isNotNull()).select("file_id", "line", "reason")


def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    return badrows.split_records(table(spark, d, "raw_lines"))[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    counted = skew.count_messages(table(spark, d, "requests"), "job_id", "request_id")
    totals = table(spark, d, "batch_jobs").select(F.col("id").alias("job_id"), F.col("result_metadata.total").alias("total"))
    return skew.unequal_totals(totals, counted, "job_id", "total").select("job_id").distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return skew.count_messages(table(spark, d, "requests"), "job_id", "request_id").select("job_id", "messages")


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_kept_queue, p2_found, p2_nodes, p2_bridge, *map(_relation, RELATIONS), p2_logprobs, p3_found, p3_report, p4_found, p4_valid, p5_found, p5_counts)}

_COUNTED = "SELECT job_id, CAST(count(DISTINCT request_id) + count(*) FILTER (request_id IS NULL) AS BIGINT) AS messages FROM requests WHERE job_id IS NOT NULL GROUP BY job_id"
_REFS = r"""refs AS (
  SELECT id AS job_id, 'input_file_id' AS ref_field, trim(spec.input_file_id, E' \t\n') AS ref, spec.created_at AS at FROM batch_jobs
  UNION ALL SELECT id, 'output_file_id', trim(status.output_file_id, E' \t\n'), status.finalizing_at FROM batch_jobs),
lives AS (SELECT id, min(arrived_at) AS arrived, min(deleted_at) AS deleted FROM file_objects WHERE id IS NOT NULL GROUP BY id)"""
_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_PLAIN = "CASE WHEN {0} LIKE '\"%' THEN replace({0}[2:-2], '\"\"', '\"') ELSE {0} END"

_TREE = r"""
WITH docs AS (SELECT request_id, 'params' AS side, params AS doc FROM inference_requests UNION ALL SELECT request_id, 'response', response FROM inference_responses),
raw AS (SELECT d.request_id, d.side, t.id, t.parent, lower(t.type) AS type, t.key, t.fullkey, t.path, t.value FROM docs d, json_tree(d.doc) t),
tree AS (SELECT a.request_id, a.side, replace(regexp_replace(a.fullkey[2:], '\[(\d+)\]', '/\1', 'g'), '.', '/') AS node_path,
  CASE WHEN b.id IS NOT NULL THEN replace(regexp_replace(b.fullkey[2:], '\[(\d+)\]', '/\1', 'g'), '.', '/') END AS parent_path,
  CASE WHEN a.type = 'array' AND b.type = 'object' THEN a.key ELSE regexp_extract(a.fullkey, '^.*\.([^.\[]+)\[', 1) END AS relation,
  CASE WHEN b.type = 'object' THEN a.key END AS key, CASE WHEN b.type = 'array' THEN regexp_extract(a.fullkey, '\[(\d+)\]$', 1)::BIGINT END AS ordinal, a.type AS kind, b.type AS parent_kind, a.value
  FROM raw a LEFT JOIN raw b ON a.request_id = b.request_id AND a.side = b.side AND a.parent = b.id WHERE a.type IN ('object', 'array'))"""


def _relation_sql(relation: str, single: bool, fields: dict[str, str]) -> str:
    columns = []
    for spec, key in fields.items():
        name, _, kind = spec.partition(" ")
        columns.append(f"CASE WHEN json_type(value, '$.{key}') NOT IN ('OBJECT', 'ARRAY') THEN TRY_CAST(value ->> '$.{key}' AS {kind or 'VARCHAR'}) END AS {name}")
    rows = f"kind = 'object' AND key = '{relation}'" if single else f"kind = 'object' AND parent_kind = 'array' AND relation = '{relation}'"
    return f"{_TREE} SELECT request_id AS doc_key, side, node_path, parent_path, ordinal, {', '.join(columns)} FROM tree WHERE {rows}"


_RECORDS = rf"""
WITH r AS (SELECT file_id, line, CASE WHEN right(raw_text, 1) = chr(13) THEN raw_text[:-2] ELSE coalesce(raw_text, '') END AS t FROM raw_lines),
f AS (SELECT *, regexp_full_match(t, '(?s){_FIELD}(,{_FIELD})*') AS well, regexp_extract(t, '(?s)^{",".join([_FIELD] * 6)}$', ['a', 'b', 'c', 'd', 'e', 'f']) AS x, regexp_full_match(t, '(?s){",".join([_FIELD] * 6)}')
  AND NOT regexp_matches(regexp_replace(rtrim(t, chr(13)), '"(?:[^"]|"")*"', '', 'g'), '[\r\n]') AS six FROM r),
v AS (SELECT *, {_PLAIN.format("x.a")} AS a, {_PLAIN.format("x.b")} AS b, {_PLAIN.format("x.c")} AS c, {_PLAIN.format("x.d")} AS d, {_PLAIN.format("x.e")} AS e, {_PLAIN.format("x.f")} AS s FROM f),
w AS (SELECT *, regexp_replace(e, '"(?:[^"\\]|\\.)*"', '""', 'g') AS bare FROM v)"""
_REJECTED = rf"""NOT well OR NOT six OR a = '' OR NOT regexp_full_match(c, 'batch_[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}')
  OR d NOT IN ({", ".join(f"'{e}'" for e in badrows.END_POINTS)}) OR s NOT IN ('0', '1') OR NOT json_valid(e)
  OR (CASE WHEN json_valid(e) THEN json_type(e) END) <> 'OBJECT' OR regexp_matches(bare, ',\s*[}}\]]|NaN|Infinity')"""

SQL = {
    "p1_found": """
SELECT 'requests' AS table_name, row_seq FROM (SELECT row_seq, row_number() OVER (PARTITION BY request_id ORDER BY delivered_at NULLS LAST, row_seq) AS r FROM requests WHERE request_id IS NOT NULL) WHERE r > 1
UNION ALL
SELECT 'job_queue', enqueue_seq FROM (SELECT enqueue_seq, row_number() OVER (PARTITION BY id ORDER BY delivered_at NULLS LAST, enqueue_seq) AS r FROM job_queue WHERE id IS NOT NULL) WHERE r > 1""",
    "p1_kept": """
SELECT * EXCLUDE (r) REPLACE (epoch_us(delivered_at) AS delivered_at, epoch_us(sent_at) AS sent_at)
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY delivered_at NULLS LAST, row_seq) AS r FROM requests) WHERE r = 1 OR request_id IS NULL""",
    "p1_kept_queue": """
SELECT * EXCLUDE (r) REPLACE (epoch_us(delivered_at) AS delivered_at, epoch_us(slo) AS slo)
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delivered_at NULLS LAST, enqueue_seq) AS r FROM job_queue) WHERE r = 1 OR id IS NULL""",
    "p2_found": r"""
WITH docs AS (SELECT request_id, 'params' AS side, params AS doc FROM inference_requests UNION ALL SELECT request_id, 'response', response FROM inference_responses),
tree AS (SELECT d.request_id, d.side, t.id, t.parent, t.type, t.fullkey FROM docs d, json_tree(d.doc) t)
SELECT a.request_id, a.side, replace(regexp_replace(a.fullkey[2:], '\[(\d+)\]', '/\1', 'g'), '.', '/') AS node_path
FROM tree a JOIN tree b ON a.request_id = b.request_id AND a.side = b.side AND a.parent = b.id
WHERE a.type = 'OBJECT' AND b.type = 'ARRAY'""",
    "p2_bridge": f"""{_TREE}
SELECT request_id AS doc_key, side, node_path, parent_path, relation, key, CAST(ordinal AS BIGINT) AS ordinal, kind, parent_kind FROM tree""",
    **{f"p2_{name}": _relation_sql(*spec) for name, spec in RELATIONS.items()},
    "p2_logprobs": _relation_sql("content", False, {"token": "token", "logprob double": "logprob"}) + " AND parent_path LIKE '%/logprobs/content'",
    "p4_found": f"""{_RECORDS}
SELECT file_id, line, CASE WHEN NOT well THEN 'quoting' WHEN NOT six THEN 'column_count' ELSE 'invalid_value' END AS reason FROM w WHERE {_REJECTED}""",
    "p4_valid": f"""{_RECORDS}
SELECT file_id, line, a AS request_id, b AS model, c AS job_id, d AS end_point, e AS request_body, CAST(s AS INTEGER) AS status FROM w WHERE NOT ({_REJECTED})""",
    "p3_found": f"""
WITH {_REFS}
SELECT DISTINCT job_id, ref_field, kind AS orphan_kind FROM (
  SELECT r.job_id, r.ref_field, CASE WHEN l.id IS NULL THEN 'missing' WHEN l.deleted <= r.at THEN 'deleted' WHEN l.arrived > r.at THEN 'late' END AS kind
  FROM refs r LEFT JOIN lives l ON r.ref = l.id WHERE r.ref <> '') WHERE kind IS NOT NULL""",
    "p3_report": r"""
WITH RECURSIVE every AS (
  SELECT 'batch_jobs' AS t, id AS row_key, id AS own_key, 'input_file_id' AS field, 'file_objects' AS parent, spec.input_file_id AS ref, spec.created_at AS moment FROM batch_jobs
  UNION ALL SELECT 'batch_jobs', id, id, 'output_file_id', 'file_objects', status.output_file_id, status.finalizing_at FROM batch_jobs
  UNION ALL SELECT 'requests', CAST(row_seq AS VARCHAR), request_id, 'job_id', 'batch_jobs', job_id, epoch_us(sent_at) // 1000000 FROM requests
  UNION ALL SELECT 'job_queue', CAST(enqueue_seq AS VARCHAR), NULL, 'id', 'batch_jobs', id, epoch_us(delivered_at) // 1000000 FROM job_queue
  UNION ALL SELECT 'raw_lines', file_id || ':' || line, NULL, 'file_id', 'file_objects', file_id, epoch_us(loaded_at) // 1000000 FROM raw_lines
  UNION ALL SELECT 'inference_requests', request_id, request_id, 'request_id', 'requests', request_id, epoch_us(created_at) // 1000000 FROM inference_requests
  UNION ALL SELECT 'inference_responses', request_id, NULL, 'request_id', 'inference_requests', request_id, epoch_us(received_at) // 1000000 FROM inference_responses),
refs AS (SELECT DISTINCT t, row_key, own_key, field, parent, trim(ref, E' \t\n') AS ref, moment FROM every WHERE trim(ref, E' \t\n') <> ''),
lives AS (SELECT 'file_objects' AS parent, id, min(arrived_at) AS arrived, min(deleted_at) AS deleted FROM file_objects WHERE id IS NOT NULL GROUP BY id
  UNION ALL SELECT DISTINCT 'batch_jobs', id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM batch_jobs WHERE id IS NOT NULL
  UNION ALL SELECT DISTINCT 'requests', request_id, NULL, NULL FROM requests WHERE request_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'inference_requests', request_id, NULL, NULL FROM inference_requests WHERE request_id IS NOT NULL),
direct AS (SELECT * FROM (SELECT r.*, CASE WHEN l.id IS NULL THEN 'missing' WHEN l.deleted <= r.moment THEN 'deleted' WHEN l.arrived > r.moment THEN 'late' END AS kind FROM refs r LEFT JOIN lives l ON r.parent = l.parent AND r.ref = l.id) WHERE kind IS NOT NULL),
lost(parent, ref) AS (
  SELECT t, own_key FROM direct WHERE own_key IS NOT NULL
  UNION SELECT r.t, r.own_key FROM refs r JOIN lost ON r.parent = lost.parent AND r.ref = lost.ref WHERE r.own_key IS NOT NULL),
found AS (
  SELECT t, field, moment, kind, false AS inherited FROM direct
  UNION ALL SELECT t, field, moment, 'inherited', true FROM refs r SEMI JOIN lost ON r.parent = lost.parent AND r.ref = lost.ref WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.t = r.t AND d.row_key = r.row_key AND d.field = r.field AND d.ref = r.ref))
SELECT t AS table_name, field, DATE '1970-01-01' + CAST(floor(moment / 86400) AS INTEGER) AS day, kind AS orphan_kind, inherited, count(*) AS orphans FROM found GROUP BY ALL""",
    "p5_found": f"""
SELECT b.id AS job_id FROM batch_jobs b LEFT JOIN ({_COUNTED}) c ON b.id = c.job_id
WHERE b.result_metadata.total IS NOT NULL AND b.result_metadata.total <> coalesce(c.messages, 0)""",
    "p5_counts": _COUNTED,
}
