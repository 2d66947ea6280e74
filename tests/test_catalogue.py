"""Every query of the core beside its SQL in DuckDB, over the smallest tables."""

import datetime
import math
import os

import pytest

from textquarry.plans.catalogue import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(v[k]) for k in order]) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    if name in SQL:
        cur = duck.execute(SQL[name])
        columns = [x[0] for x in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, cur.fetchall())


def test_most_queries_have_sql():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 0.9 * len(QUERIES)


def test_entry(spark):
    import __spark_entry__

    if os.path.isdir(__spark_entry__.SMOKE_DIR):
        assert __spark_entry__.entry(spark).columns == ["lang", "skip_reason", "n"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
