"""Every query with an oracle against DuckDB on the smallest tables; the others return rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lexmill.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return "nan" if isinstance(x, float) and math.isnan(x) else f"{float(x):.6f}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()[:10]
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    other = duck.sql(ORACLES[name])
    assert sorted(other.columns) == columns
    order = [other.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[k]) for k in order) for r in other.fetchall()) == rows


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
