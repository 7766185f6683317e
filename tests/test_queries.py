"""Every query with SQL against DuckDB, and the entry's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from sieveline.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert driver.entry(spark).first()["total_issues"] > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_rules_stay_in_one_pass(spark):
    from sieveline.operators.match import match
    from sieveline.operators.rules import all_rules
    from sieveline.sources.files import lines
    from sieveline.queries import _documents

    plan = match(lines(_documents(spark, SF)), all_rules())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
