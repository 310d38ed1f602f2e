"""Every registered query with an oracle matches DuckDB on the sf0.001 tables."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from framewise.session import TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cols = sdf.columns
    got = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=str)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    exp = sorted((tuple(norm(r[i]) for i in idx) for r in res.fetchall()), key=str)
    assert got == exp


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["l_returnflag", "l_extendedprice"]
    assert df.count() == 3
