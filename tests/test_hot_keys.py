"""Operators whose groups or lists must not gather in one task, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import badrows, events, process, queue, store
from weftline.session import own_folder, remove


def test_pages_by_cursor(spark):
    r = random.Random(1)
    rows = [(f"id{i}", r.choice([None, 1, 2, 3])) for i in range(23)]
    df = spark.createDataFrame(rows, "id string, n int").repartition(3)
    want = [k for k, n in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))]
    got, cursor = [], ""
    while cursor is not None:
        page, cursor = store.page_after(df, ["n", "id"], 5, cursor)
        got += [x.id for x in page.collect()]
    assert got == want
    assert store.page_after(df, ["n", "id"], 5, None)[0].count() == 0 and store.page_after(df.limit(0), ["n", "id"], 5)[1] is None
    for bad in ("???", store.cursor_of(df.first(), ["id"])):
        with pytest.raises(ValueError):
            store.page_after(df, ["n", "id"], 5, bad)


def test_errors_without_a_line_and_repeated_lines_come_in_chunks(spark):
    rows = [("j", None, f"c{i}", "m", None) for i in range(25)] + [("j", 7, f"d{i}", None, None) for i in range(12)] + [(None, 1, "x", "m", "p")]
    listed = process.error_list(spark.createDataFrame(rows, "job_id string, line int, code string, message string, param string"), span=10).collect()
    sizes = {(x.job_id, x.chunk): len(x.errors) for x in listed}
    assert sizes == {("j", 0): 10, ("j", 1): 10, ("j", 2): 10, ("j", 3): 7, (None, 0): 1}
    assert sorted(e.code for x in listed for e in x.errors) == sorted(x[2] for x in rows)


def test_a_hot_group_is_cut_into_stretches(spark):
    df = spark.createDataFrame([("m", "e", i) for i in range(3000)] + [(None, "e", -1), ("q", None, -2)], "model string, end_point string, n int")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = process.grouped(df, "model", "end_point", rows=200).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert sorted(x.n for x in got) == sorted([*range(3000), -1, -2])
    most = max(sum(x.task == t for x in got) for t in {x.task for x in got})
    assert most < 1500


def test_nearest_centroid_in_blocks(spark):
    r = random.Random(3)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [1.0]), (None, [0.0] * 4), (62, [0.5, 0.5, 0.5, 0.5])]
    centroids = [(label, [r.uniform(-1, 1) for _ in range(4)]) for label in range(25)] + [(30, [0.5] * 4), (26, [0.5] * 4), (27, None)]
    v, c = spark.createDataFrame(vectors, "id int, v array<double>"), spark.createDataFrame(centroids, "label int, v array<double>")
    want = {}
    for k, x in vectors:
        if k is not None and x is not None and len(x) == 4:
            want[k] = min((sum((a - b) ** 2 for a, b in zip(x, y)), label) for label, y in centroids if y)[1]
    for block in (1000, 4):
        assert {x.id: x.label for x in process.nearest_centroid(v, c, "id", "v", "label", block).collect()} == want
    assert process.nearest_centroid(v, c.limit(0), "id", "v", "label").count() == 0


def test_calls_in_flight(spark):
    def client():
        import threading
        import time

        now, lock = {}, threading.Lock()

        def answer(request_id, model, body):
            with lock:
                now[model] = now.get(model, 0) + 1
                seen = (now[model], sum(now.values()))
            time.sleep(0.02)
            with lock:
                now[model] -= 1
            return f"{seen[0]},{seen[1]}"

        return answer

    lines = spark.createDataFrame([(str(i), "j", "ab"[i % 2], "x") for i in range(60)], "request_id string, job_id string, model string, request_body string").coalesce(1)
    got = process.run_lines(lines, client, 6, per_model={"a": 2}).collect()
    counts = [(x.request_id, *map(int, x.response.split(","))) for x in got]
    assert max(own for k, own, _ in counts if int(k) % 2 == 0) == 2 and 3 <= max(total for *_, total in counts) <= 6
    assert [x.request_id for x in got] == [str(i) for i in range(60)]


def test_files_of_a_large_job(spark):
    place = own_folder(spark, "test")
    rows = [(f"r{i}", "big" if i % 3 else None, f"a{i}" if i % 2 else None, None if i % 2 else "UNKNOWN", None, 1) for i in range(300)]
    output, errors = process.write_results(spark.createDataFrame(rows, process.RESULT), place, rows_per_file=40)
    for where, odd in ((output, 1), (errors, 0)):
        read = spark.read.json(where).withColumn("file", F.input_file_name())
        assert sorted(x.request_id for x in read.collect()) == sorted(f"r{i}" for i in range(300) if i % 2 == odd)
        assert max(x["count"] for x in read.groupBy("file").count().collect()) <= 40
        assert {x.job_id for x in read.select("job_id").distinct().collect()} == {"big", None}
    assert remove(spark, place) and not remove(spark, place)


def test_versions_are_cleared_and_closed(spark):
    place = own_folder(spark, "test")
    v = store.Versions(spark, place)
    assert v.clear() == 0
    for n in (1, 2, 3, 4):
        v.write(spark.range(n))
    assert v.clear(keep=1) == 2 and v.read().count() == 4 and v.clear() == 1 and v.read().count() == 4
    v.close()
    assert v.current() is None


def test_buffers_drop_what_does_not_fit(spark):
    sent = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1)], "id string, n int")
    channels = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "z")], "id string, channel string")
    kept, dropped = events.buffered(sent, channels, "channel", ["n", "id"], 7)
    assert sorted((x.channel, x.n, x.id) for x in kept.collect()) == sorted([("x", i, "a") for i in range(7)] + [("y", n, k) for n, k in sorted([(i, "a") for i in range(20)] + [(1, "b")])[:7]])
    assert {x.channel: x.dropped for x in dropped.collect()} == {"x": 13, "y": 14}


def test_entries_without_a_job_go_back(spark):
    q = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), (None, 3, 3), ("a", 4, 4)], "id string, slo int, enqueue_seq bigint")
    taken, rest = queue.dequeue(q, 3)
    good, back = queue.put_back(rest, taken, spark.createDataFrame([("a",), ("a",)], "id string"))
    assert [x.enqueue_seq for x in good.collect()] == [1] and sorted(x.enqueue_seq for x in back.collect()) == [2, 3, 4]
    assert [x.enqueue_seq for x in queue.dequeue(q, 2, by=[F.col("slo").desc()])[0].collect()] == [4, 3]


def test_line_breaks_outside_quotes_agree_with_the_sql(spark):
    import duckdb

    from weftline.plans import problems

    job, body = "batch_01234567-89ab-cdef-0123-456789abcdef", '"{""a"":1}"'
    good = ["r", "m", job, "/v1/responses", body, "0"]
    rows = []
    for at, sign in [(0, "\r"), (1, "\n"), (1, "\r"), (5, "\r"), (5, "\r\r"), (5, "\r\n"), (4, "")]:
        fields = list(good)
        fields[at] = fields[at][:1] + sign + fields[at][1:] if at < 5 else fields[at] + sign
        rows.append(("f", len(rows), ",".join(fields)))
    rows += [("f", 90, ",".join(['"a\rb\n"', *good[1:]])), ("f", 91, ",".join(good) + ',"x\r'), ("f", 92, "")]
    c = duckdb.connect()
    c.execute("create table raw_lines (file_id varchar, line bigint, raw_text varchar)")
    c.executemany("insert into raw_lines values (?, ?, ?)", rows)
    want = sorted(c.execute(problems.SQL["p4_found"]).fetchall())
    found = badrows.parse_records(spark.createDataFrame(rows, "file_id string, line bigint, raw_text string")).where("reason is not null")
    assert sorted((x.file_id, x.line, x.reason) for x in found.collect()) == want
