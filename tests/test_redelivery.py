import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import redelivery
from weftline.plans import problems
from weftline.sources.tables import table

SMALL = "/root/testdata/sf0.001"

SCHEMA = "row_seq bigint, request_id string, delivered_at bigint, n string, last int"


def brute(rows):
    best, out = {}, []
    big = 1 << 60
    for r in rows:
        if r[1] is not None:
            k = (r[2] is None, big if r[2] is None else r[2], r[0])
            if r[1] not in best or k < best[r[1]]:
                best[r[1]] = k
    for r in rows:
        if r[1] is not None and (r[2] is None, big if r[2] is None else r[2], r[0]) != best[r[1]]:
            out.append(r[0])
    return sorted(out)


def test_against_brute_force_with_a_hot_identifier(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, "hot", "hot", f"k{r.randint(0, 60)}", "Hot", "hot "]), r.choice([None, *range(5)]), "x", 1) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (1_000_000, 7):  # in one slice each, and with the hot identifier cut into many
        got = redelivery.keep_one(df, "request_id", ["delivered_at", "row_seq"], slice_rows=limit)
        assert sorted(x.row_seq for x in got.surplus.collect()) == brute(rows)
        kept = got.kept.collect()
        assert len(kept) + got.surplus.count() == len(rows)
        assert got.kept.columns == df.columns
        ids = [x.request_id for x in kept if x.request_id is not None]
        assert len(ids) == len(set(ids))


def test_equal_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a", 5, None, None)] * 4 + [(2, None, None, None, None)] * 2, SCHEMA)
    got = redelivery.keep_one(df, "request_id", ["delivered_at", "row_seq"])
    assert got.kept.where("request_id = 'a'").count() == 1 and got.surplus.count() == 3
    assert got.kept.where("request_id is null").count() == 2


def test_empty_and_stored_with_new(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert redelivery.keep_one(empty, "request_id", ["delivered_at", "row_seq"]).kept.count() == 0
    new = spark.createDataFrame([(9, "a", 1, "late", 0)], SCHEMA)
    stored = spark.createDataFrame([(1, "a", 3, "old", 0)], SCHEMA)
    got = redelivery.deduplicate(stored, new, "request_id", ["delivered_at", "row_seq"])
    assert [x.n for x in got.kept.collect()] == ["late"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_kept_queue_is_all_but_the_surplus(spark):
    # times come out as microseconds, which compare the same everywhere
    rows = table(spark, SMALL, "job_queue").withColumns({c: F.unix_micros(c) for c in ("delivered_at", "slo")})
    kept = problems.QUERIES["p1_kept_queue"](spark, SMALL)
    surplus = {x.row_seq for x in problems.p1_found(spark, SMALL).where("table_name = 'job_queue'").collect()}
    assert kept.columns == rows.columns and surplus
    assert sorted(kept.collect(), key=str) == sorted((x for x in rows.collect() if x.enqueue_seq not in surplus), key=str)
