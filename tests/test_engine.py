"""Semantics of the batch engine that the tables do not reach."""

import os
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.operators import checks, codec, events, metrics, process, queue, status, store
from weftline.operators.running import running_sum
from weftline.sources import config, files
from weftline.streaming import live


@pytest.mark.parametrize(
    ("text", "seconds"),
    [("24h", 86400), ("1h30m", 5400), ("-1.5h", -5400), ("+5m", 300), (".5h", 1800), ("1.h", 3600), ("0", 0), ("-0", 0), ("100ms", 0.1), ("2us", 0.000002), ("3ns", 0.000000003)]
    + [(t, None) for t in ("1d", "5 h", "", "1h 30m", "h", "5", "--5m", None)],
)
def test_durations(spark, text, seconds):
    row = spark.createDataFrame([(text,)], "t string").select(scalars.duration_seconds(F.col("t")), scalars.is_duration(F.col("t"))).first()
    assert (row[0] is None) == (seconds is None) and row[1] == (seconds is not None)
    if seconds is not None:
        assert float(row[0]) == pytest.approx(seconds)


def test_scalars(spark):
    codes = [400, 401, 403, 404, 422, 429, 501, 500, 503, 402, 409]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in codes], "c int").select(scalars.error_code_to_type(F.col("c"))).collect()]
    assert got[:7] == list(scalars.ERROR_TYPES.values()) and got[7:] == ["InternalServerError"] * 2 + ["APIConnectionError"] * 2
    sizes = [0, 99, 100, 999, 1000, 9999, 10000, 29999, 30000]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in sizes], "c int").select(scalars.size_bucket(F.col("c"))).collect()]
    assert got == ["100", "100", "1000", "1000", "10000", "10000", "30000", "30000", "large"]
    row = spark.range(1).select(scalars.error_type(F.lit(404), F.lit("")), scalars.error_type(F.lit(404), F.lit("Own")), scalars.tag_condition_name(F.lit(2)), scalars.join_path(F.lit("d"), F.lit("f")), scalars.join_path(F.lit("d"), F.lit("")), scalars.identifier(F.lit(""), F.lit("new")), F.length(scalars.random_letters(12, 1))).first()
    assert tuple(row) == ("NotFoundError", "Own", "or", "d/f", "", "new", 12)


@pytest.mark.parametrize(("text", "limit", "start"), [("", 20, 0), ("0", None, 0), ("1", 1, 1), ("100", 100, 100), ("101", None, 101), ("-1", None, None), ("10abc", 10, 10), ("abc", None, None), (" 7", 7, 7), ("+5", 5, 5), (None, 20, 0)])
def test_paging_texts(spark, text, limit, start):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(checks.page_limit(F.col("t")), checks.page_start(F.col("t"))).first()) == (limit, start)


def test_request_rules_in_order(spark):
    schema = "w string, e string, f string, x struct<seconds bigint, anchor string>"
    good = ["24h", "/v1/embeddings", "file-1", None]
    cases = [
        (good, None), (["", "", "", (1, "")], "completion_window is required"), (["1d", "", "", None], "completion_window must be a valid duration (e.g., 24h)"), (["1h", None, "", None], "endpoint is required"),
        (["1h", "/x", "", None], "invalid endpoint: /x"), (["1h", "/v1/responses", "", None], "input_file_id is required"), ([*good[:3], (3600, "")], "output_expires_after.anchor is required"),
    ]
    bad = "output_expires_after.seconds must be between 3600 (1 hour) and 2592000 (30 days)"
    cases += [([*good[:3], (n, "other")], e) for n, e in ((3599, bad), (3600, None), (2592000, None), (2592001, bad))]
    df = spark.createDataFrame([tuple(c) for c, _ in cases], schema)
    got = [r[0] for r in df.select(checks.batch_request_error(F.col("w"), F.col("e"), F.col("f"), F.col("x"))).collect()]
    assert got == [e for _, e in cases]


def test_other_rules(spark):
    rows = spark.createDataFrame([("", 1, 1), ("a", None, 1), ("a", 1, 0), ("a", 1, 5)], "id string, slo int, ttl int")
    got = [r[0] for r in rows.select(checks.job_error(F.col("id"), F.col("slo"), F.col("ttl"))).collect()]
    assert got == ["ID is empty", "SLO is zero for ID a", "TTL is invalid for ID a", None]
    rows = spark.createDataFrame([("a", -1, 1), ("a", 0, 1), ("a", 2, 1), ("a", 3, 1), ("a", 1, 0)], "id string, k int, ttl int")
    got = [r[0] for r in rows.select(checks.event_error(F.col("id"), F.col("k"), F.col("ttl"))).collect()]
    assert got == ["event type -1 is invalid for ID a", None, None, "event type 3 is invalid for ID a", "TTL is invalid for ID a"]
    paths = spark.createDataFrame([("/metrics",), ("/v1/batches",)], "p string")
    assert [r[0] for r in paths.where(checks.observed(F.col("p"))).collect()] == ["/v1/batches"]
    cats = spark.createDataFrame([("RATE_LIMIT",), ("SERVER_ERROR",), ("INVALID_REQ",), ("AUTH_ERROR",), ("UNKNOWN",)], "c string")
    assert [r[0] for r in cats.select(checks.is_retryable(F.col("c"))).collect()] == [True, True, False, False, False]


def test_store(spark):
    jobs = spark.createDataFrame([("a", ["x", "y"], 1), ("b", ["x"], 2), ("c", None, 3), ("d", [], 4)], "id string, tags array<string>, n int")
    ids = spark.createDataFrame([(0, "c"), (1, "a"), (2, "zz"), (3, "c")], "place int, id string")
    assert [r.id for r in store.by_ids(jobs, ids).collect()] == ["c", "a", "c"]
    pick = lambda *a: sorted(r.id for r in store.by_tags(jobs, *a).collect())
    assert pick(["x", "y"], True) == ["a"] and pick(["x", "q"], False) == ["a", "b"] and pick([], True) == [] and pick([], False) == []
    own, envelope = store.page(jobs, [F.col("n")], 2, 1)
    assert [r.id for r in own.collect()] == ["b", "c"] and tuple(envelope.first()) == ("b", "c", True)
    assert tuple(store.page(jobs, [F.col("n")], 2, 9)[1].first()) == ("", "", False)
    patches = spark.createDataFrame([("a", [], 7), ("b", ["new"], None), ("q", ["z"], 1)], "id string, tags array<string>, n int")
    patched, missing = store.patch(jobs, patches, ["tags", "n"])
    assert {r.id: (r.tags, r.n) for r in patched.collect()} == {"a": (["x", "y"], 7), "b": (["new"], 2), "c": (None, 3), "d": ([], 4)}
    assert [r.id for r in missing.collect()] == ["q"]
    left, gone = store.delete(jobs, ids)
    assert sorted(r.id for r in left.collect()) == ["b", "d"] and [r.id for r in gone.collect()] == ["c", "a"]
    assert store.upsert(jobs, patches).count() == 5


def test_versions(spark, tmp_path):
    v = store.Versions(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        v.read()
    v.write(spark.range(3))
    before = v.read()
    v.write(before.unionByName(spark.range(2)))
    assert v.read().count() == 5 and before.count() == 3


def test_queue(spark):
    q = spark.createDataFrame([("a", 5, 1), ("b", 3, 2), ("a", 3, 3), ("c", None, 4)], "id string, slo int, enqueue_seq bigint")
    taken, rest = queue.dequeue(q, 2)
    assert [r.enqueue_seq for r in taken.collect()] == [2, 3] and sorted(r.enqueue_seq for r in rest.collect()) == [1, 4]
    assert queue.dequeue(q, 0)[0].count() == 0 and queue.dequeue(q, 99)[1].count() == 0 and queue.dequeue(q.limit(0), 3)[0].count() == 0
    ids = spark.createDataFrame([("a",), ("a",), ("zz",)], "id string")
    left, missing = queue.remove_first(q, ids)
    assert sorted(r.enqueue_seq for r in left.collect()) == [1, 2, 4] and [r.id for r in missing.collect()] == ["zz"]
    new = spark.createDataFrame([(f"n{i}", 1, 100 - i) for i in range(50)], "id string, slo int, arrival int")
    got = queue.enqueue(q, new).where("id like 'n%'").orderBy("enqueue_seq").collect()
    assert [r.id for r in got] == [f"n{i}" for i in range(49, -1, -1)] and [r.enqueue_seq for r in got] == list(range(5, 55))


def test_events_and_status(spark):
    sent = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    subs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "id string, channel string")
    assert events.fan_out(sent, subs).count() == 3 and sorted(r.id for r in events.sent(sent, subs).collect()) == ["a", "b"]
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    log = spark.createDataFrame([("a", events.PAUSE, 1), ("a", events.RESUME, 2), ("b", events.PAUSE, 1)], "id string, type int, seq int")
    assert sorted(r.id for r in events.runnable(jobs, log, ["seq"]).collect()) == ["a", "c"]
    cells = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "id string, data string, seq int")
    assert status.latest(cells, "id", "data", ["seq"]).collect() == [("a", "new")]
    row = spark.range(1).select(status.alive(F.lit(10), F.lit(5), F.lit(14)), status.alive(F.lit(10), F.lit(5), F.lit(15)), status.alive(F.lit(10), F.lit(0), F.lit(99))).first()
    assert tuple(row) == (True, False, True)


def test_codec(spark):
    blobs = ['{"status":"validating"}', "not json", "", "null", None, "[1]", '{"status":"failed"}']
    df = spark.createDataFrame([(str(i), '{"endpoint":"/v1/responses"}', b) for i, b in enumerate(blobs)], "id string, spec string, status string")
    assert [r.id for r in codec.jobs_as_batches(df).orderBy("id").collect()] == ["0", "6"]
    with pytest.raises(Exception, match="unreadable job"):
        codec.jobs_as_batches(df, strict=True).collect()
    requests = spark.createDataFrame([("f", "/v1/responses", "90m", None, (3600, "created_at")), ("f", "/v1/responses", "1.5s", None, (3600, "later")), ("", "/v1/responses", "1h", None, None)], codec.REQUEST)
    jobs, bad = codec.create(requests, F.col("completion_window"), F.lit(1000))
    got = {r.id: r for r in jobs.collect()}
    assert got["batch_90m"].ttl == 9000 and got["batch_1.5s"].ttl == 2592000 and got["batch_90m"].slo.timestamp() == 6400 and got["batch_1.5s"].slo.timestamp() == 1001.5
    assert got["batch_90m"].status.status == "validating" and got["batch_90m"].tags is None
    assert [r.error for r in bad.collect()] == ["input_file_id is required"]


def test_lines_retries_and_isolation(spark):
    def client():
        seen = {}

        def answer(request_id, model, body):
            seen[request_id] = seen.get(request_id, 0) + 1
            if body == "busy" and seen[request_id] < 3:
                raise process.InferenceError("RATE_LIMIT", "slow down")
            if body == "down":
                raise process.InferenceError("SERVER_ERROR", "down")
            if body == "bad":
                raise process.InferenceError("INVALID_REQ", "bad")
            if body == "crash":
                raise RuntimeError("boom")
            return body.upper()

        return answer

    lines = spark.createDataFrame([(b, "j", "m", b) for b in ("ok", "busy", "down", "bad", "crash")], "request_id string, job_id string, model string, request_body string")
    got = {r.request_id: r for r in process.run_lines(lines, client, 2).collect()}
    assert (got["ok"].response, got["ok"].attempts) == ("OK", 1) and (got["busy"].response, got["busy"].attempts) == ("BUSY", 3)
    assert (got["down"].category, got["down"].attempts) == ("SERVER_ERROR", 3) and got["bad"].attempts == 1 and got["crash"].category == "UNKNOWN"
    done = spark.createDataFrame([("ok",)], "request_id string")
    assert process.remaining(lines, done, ["request_id"]).count() == 4


def test_error_lists_and_thresholds(spark):
    rows = spark.createDataFrame([("j", i, f"c{i}", "m", None) for i in (3, 1, 2)], "job_id string, line int, code string, message string, param string")
    one = process.error_list(rows).first()
    assert [e.line for e in one.errors] == [1, 2, 3] and one.chunk == 0
    assert {x.chunk: [e.line for e in x.errors] for x in process.error_list(rows, span=2).collect()} == {0: [1, 2], 1: [3]}  # by rank
    lines = spark.createDataFrame([("j", i, 1) for i in range(6)], "job string, line int, failed int")
    assert sorted(r.line for r in process.until_threshold(lines, "job", ["line"], F.col("failed"), 2).collect()) == [0, 1, 2]


def test_running_sums_of_a_hot_key(spark):
    rows = [("hot", i, i % 3) for i in range(500)] + [("cold", i, 1) for i in range(5)] + [(None, i, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, n int, amount int").repartition(7)
    got = running_sum(df, "amount", ["n"], ["k"], "value").collect()
    for key in ("hot", "cold", None):
        total = 0
        for r in sorted((r for r in got if r.k == key), key=lambda r: r.n):
            total += r.amount
            assert r.value == total
    assert len(got) == len(rows) and running_sum(df.limit(0), "amount", ["n"], ["k"], "value").count() == 0


def test_histogram_bounds_are_inclusive(spark):
    rows = spark.createDataFrame([("a", v) for v in (0.05, 0.1, 0.11, 5000.0, None)], "t string, v double")
    got = {r.le: r.bucket_count for r in metrics.histogram(rows, "v", metrics.exponential_bounds(0.1, 2, 15), "t").collect()}
    assert got[0.1] == 2 and got[0.2] == 3 and got[max(b for b in got if b != float("inf"))] == 3 and got[float("inf")] == 4
    text = metrics.exposition(spark.createDataFrame([('q"\n', None, 1)], "a string, b string, v int"), "x", "v", "a", "b").first()[0]
    assert text == 'x{a="q\\"\\n"} 1'


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(f'{{"custom_id":"r{i}","method":"POST","url":"/v1/responses","body":{{"n":{i}}}}}',) for i in range(20)] + [("",), ("broken",)], "value string").coalesce(1)
    place = f"{tmp_path}/f"
    with pytest.raises(ValueError, match="limit"):
        files.store(rows, place, 10)
    files.store(rows, place, 10_000)
    got = files.read_requests(spark, place).orderBy("line").collect()
    assert [r.request_id for r in got[:20]] == [f"r{i}" for i in range(20)] and got[7].request_body == '{"n":7}'
    assert [(r.line, r.valid) for r in got[19:]] == [(20, True), (22, False)]
    listed = files.list_files(spark, f"{place}/*.txt").collect()
    assert len(listed) == 1 and listed[0].size == os.path.getsize(listed[0].location.replace("file:", "", 1).replace("//", "/"))
    assert files.retrieve(spark, place)[0].count() == 22
    assert files.delete(spark, place) and not files.delete(spark, place)


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = files.read_lines(spark, str(tmp_path / "big.txt"))
        assert read.where(F.concat(F.lit("line "), (F.col("line") - 1).cast("string")) != F.col("value")).count() == 0 and read.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_settings(tmp_path):
    assert config.settings({}).page_size == 20
    with pytest.raises(ValueError, match="unknown"):
        config.settings({"max_workers": 20})
    for bad in ({"port": ""}, {"ssl_cert_file": "a"}):
        with pytest.raises(ValueError):
            config.settings(bad).check()
    with pytest.raises(FileNotFoundError):
        config.settings({"ssl_cert_file": "/none/a", "ssl_key_file": "/none/b"}).check()
    with pytest.raises(ValueError, match="files"):
        config.require({"db": 1, "files": None, "queue": None})
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump({"port": "1", "batch_ttl_seconds": 5}))
    assert config.load(str(path)).batch_ttl_seconds == 5


def test_streams(spark, tmp_path):
    rows = [(f"m{i % 30}", f"2024-01-01 00:{i // 2:02d}:00", i) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, at string, n int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = live.read_stream(spark, f"{tmp_path}/in", df.schema, files_per_trigger=1)
    seen = []
    q = live.poll(live.first_deliveries(stream, "id", "at", "2 hours"), lambda b, n: seen.extend(r.id for r in b.collect()), f"{tmp_path}/c1", once=True)
    q.awaitTermination(120)
    assert sorted(seen) == sorted({r[0] for r in rows})
    again = live.poll(live.first_deliveries(stream, "id", "at", "2 hours"), lambda b, n: seen.extend(r.id for r in b.collect()), f"{tmp_path}/c1", once=True)
    again.awaitTermination(120)
    assert len(seen) == 30  # a restarted query goes on where it stopped
    subs = spark.createDataFrame([("m1", "x"), ("m1", "y")], "id string, channel string")
    out = []
    q = live.poll(live.fan_out(stream, subs, "id"), lambda b, n: out.extend(b.collect()), f"{tmp_path}/c2", interval=0.1)
    end = time.monotonic() + 60
    while len(out) < 8 and time.monotonic() < end:
        time.sleep(0.2)
    live.drain(q, seconds=10)
    assert not q.isActive and len(out) == 8


def test_state_with_time_to_live(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "id string, v string").coalesce(1)
        df.write.parquet(f"{tmp_path}/in")
        got = []
        stream = live.expiring_state(live.read_stream(spark, f"{tmp_path}/in", df.schema), "id", "v", 60_000)
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
        end = time.monotonic() + 60
        while len(got) < 2 and time.monotonic() < end:
            time.sleep(0.2)
        live.drain(q, seconds=10)
        assert {(r.id, r.writes) for r in got} == {("a", 2), ("b", 1)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_deadline_cancels(spark):
    with pytest.raises(Exception), live.Deadline(spark, "slow", 1.0):
        spark.range(8, numPartitions=8).select(F.udf(lambda x: time.sleep(30) or x, "bigint")("id")).collect()
    assert spark.range(3).count() == 3
