"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from taxaloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in [*TABLES, "documents"]:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    answer = duck.sql(sql)
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in answer.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
