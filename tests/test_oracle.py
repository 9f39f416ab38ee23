"""Every catalog query against its DuckDB statement on the generated tables."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as E
from cadence.plans import catalog, oracle
from tests.conftest import SF001

TABLES = ["events"]


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return repr(v)


def _key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t + '.parquet')}')")
    return c


def test_every_query_has_an_oracle():
    """Of the rides; the training-data queries have their own tests."""
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries()) and set(catalog.queries()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _key(rows, df.columns) == _key(res.fetchall(), cols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 14 and df.columns == ["day_of_week", "member_casual", "average_ride_length"]
