"""Every registered query against DuckDB on the same tables, and its plan shape."""

import decimal
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from areal.plans.inputs import TABLES
from conftest import SF_DIR

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in ORACLES:
        assert got
        return
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(row[i]) for i in places) for row in relation.fetchall())


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.count() > 0 and rows.columns == ["region_id", "class_key", "color", "total", "rows"]
