"""Every query with SQL gives the same rows as DuckDB, over whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(found, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(r[i] for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    order = sorted(df.columns)
    got = rows(df.collect(), df.columns, order)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == order
    assert got == rows(result.fetchall(), names, order)
    assert got


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.catalog.QUERIES if n != "stream_daily"))
def test_plans_hold_at_scale(spark, sf_dir, name):
    """No pairwise joins, and no column is read that the query doesn't name."""
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "props" not in plan  # the wide column of events
