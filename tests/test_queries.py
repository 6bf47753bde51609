"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, compare

D = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["class_id", "iou", "acc"]
    assert df.count() == 7


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = df.toArrow()
    if name not in SQL:
        assert got.num_rows > 0
        return
    err, _ = compare(got, con.sql(SQL[name]).to_arrow_table())
    assert err is None, err
