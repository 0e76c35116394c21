"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lacuna.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
QUERIES, SQL = queries(), oracle_sql()


def table(df):
    return sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["genome", "chr", "te_start", "te_end", "strand", "type", "family"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plan_prunes_columns(spark):
    plan = QUERIES["unique_sweep_genome1"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
