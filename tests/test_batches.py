import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import batches, problems

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", [*batches.QUERIES, *problems.SQL])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=str)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(([norm(r[i]) for i in at] for r in cursor.fetchall()), key=str)
