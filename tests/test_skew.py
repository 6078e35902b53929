import random
from collections import defaultdict

from weftline.operators import skew


def test_counts_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + [f"j{r.randint(0, 50)}", None, ""]), r.choice([None, f"r{r.randint(0, 200)}"]), i) for i in range(3000)]
    want = defaultdict(lambda: [set(), 0])
    for k, item, _ in rows:
        if k is not None:
            if item is None:
                want[k][1] += 1
            else:
                want[k][0].add(item)
    df = spark.createDataFrame(rows, "job_id string, request_id string, n int")
    for share in (0.01, 0.3, 2.0):
        got = skew.count_messages(df, "job_id", "request_id", share).collect()
        assert {x.job_id: x.messages for x in got} == {k: len(s) + n for k, (s, n) in want.items()}
        assert any(x.heavy for x in got) == (share < 1)


def test_unequal_totals(spark):
    counted = spark.createDataFrame([("a", 3, True), ("b", 1, False)], "job_id string, messages bigint, heavy boolean")
    totals = spark.createDataFrame([("a", 3), ("b", 2), ("c", 0), ("d", 1), ("e", None), (None, 4)], "job_id string, total bigint")
    assert {x.job_id for x in skew.unequal_totals(totals, counted, "job_id", "total").collect()} == {"b", "d", None}


def test_empty(spark):
    empty = spark.createDataFrame([], "job_id string, request_id string")
    assert skew.count_messages(empty, "job_id", "request_id").count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, None)], "job_id string, request_id string")
    assert skew.count_messages(nulls, "job_id", "request_id").count() == 0
