from pyspark.sql import functions as F

from weftline.operators import orphans
from weftline.operators.orphans import Edge, Parent


def test_kinds_blanks_and_ties(spark):
    files = spark.createDataFrame([("f1", 10, None), ("f1", 5, 100), ("f2", 50, None), ("f3", 1, 20), (None, 1, 1), (" f4", 1, None), ("f5", None, None)], "id string, arrived_at bigint, deleted_at bigint")
    jobs = spark.createDataFrame([("ok", " f1\n", 50), ("late", "f2", 49), ("on time", "f2", 50), ("deleted", "f3\t", 20), ("before", "f3", 19), ("missing", "zz", 1), ("exact", "f4", 9), ("null", None, 1), ("blank", " \t", 1), ("no time", "f2", None), ("no time missing", "qq", None), ("cr", "f1\r", 50), ("missing", "zz", 1), ("unknown arrival", "f5", 1)], "id string, ref string, at bigint")
    lives = orphans.lifetimes(files, Parent(F.col("id"), F.col("arrived_at"), F.col("deleted_at")))
    found = orphans.direct(orphans.references(jobs, Edge("jobs", "ref", "files", F.col("ref"), F.col("id"), F.col("at"))), lives)
    assert {(x.row_key, x.orphan_kind) for x in found.collect()} == {("late", "late"), ("deleted", "deleted"), ("missing", "missing"), ("exact", "missing"), ("no time missing", "missing"), ("cr", "missing")}


def test_cascade_runs_down_the_graph_and_ends_on_cycles(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, up string, extra int")
    tables = {"a": t([("a1", None, 1)]), "b": t([("b1", "a1", 1), ("b2", "gone", 1)]), "c": t([("c1", "b1", 1), ("c2", "b2", 1)]), "d": t([("d1", "c2", 1), ("d2", "d1", 1), ("d3", "d4", 1), ("d4", "d3", 1)])}
    edges = [Edge("b", "up", "a", F.col("up"), F.col("id")), Edge("c", "up", "b", F.col("up"), F.col("id")), Edge("d", "up", "c", F.when(F.col("id") == "d1", F.col("up")), F.col("id")), Edge("d", "up", "d", F.when(F.col("id") != "d1", F.col("up")), F.col("id"))]
    parents = {n: Parent(F.col("id")) for n in tables}
    got = orphans.cascade(tables, edges, parents)
    assert {(x.table_name, x.row_key, x.inherited, x.depth) for x in got.collect()} == {("b", "b2", False, 0), ("c", "c2", True, 1), ("d", "d1", True, 2), ("d", "d2", True, 3)}
    report = orphans.report(got).collect()
    assert sum(x.orphans for x in report) == 4 and all(x.day is None for x in report)


def test_rows_that_refer_twice_and_rows_without_a_key(spark):
    t = lambda rows: spark.createDataFrame(rows, "row bigint, id string, x string, y string")
    tables = {"a": t([(1, "a1", "gone", None), (2, "a2", None, None)]), "b": t([(1, None, "a1", "gone"), (2, None, "a1", "gone"), (3, "b3", "a2", "gone"), (4, "b4", "a1", "a1")])}
    edges = [Edge("a", "x", "a", F.col("x"), F.col("row")), Edge("b", "x", "a", F.col("x"), F.col("row")), Edge("b", "y", "a", F.col("y"), F.col("row"))]
    got = orphans.cascade(tables, edges, {"a": Parent(F.col("id"))})
    assert sorted((x.table_name, x.row_key, x.field, x.inherited) for x in got.collect()) == [
        ("a", "1", "x", False), ("b", "1", "x", True), ("b", "1", "y", False), ("b", "2", "x", True), ("b", "2", "y", False), ("b", "3", "y", False), ("b", "4", "x", True), ("b", "4", "y", True)
    ]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, up string")
    got = orphans.cascade({"a": empty, "b": empty}, [Edge("b", "up", "a", F.col("up"), F.col("id"))], {"a": Parent(F.col("id"))})
    assert got.count() == 0 and orphans.report(got).count() == 0
