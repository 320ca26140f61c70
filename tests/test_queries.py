"""Every query against its SQL in DuckDB, by value; names and columns agree."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tideglass.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in (x.asDict().values() if hasattr(x, "asDict") else x))
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return None if x != x else float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
