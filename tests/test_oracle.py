"""Every registered query equals its DuckDB oracle on the smallest driver tables."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from shopfront.plans import registry

TABLES = ("region nation customer supplier part orders lineitem events").split()


def _norm(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(table):
    cols = sorted(table.column_names)
    data = {c: table.column(c).to_pylist() for c in cols}
    return cols, sorted((tuple(_norm(data[c][i]) for c in cols) for i in range(table.num_rows)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


registry.load_all()
ORACLES = dict(registry.ORACLES)
QUERIES = {name: fn for name, fn in E.queries().items() if name in registry.QUERIES}


def test_every_query_has_an_oracle():
    # the brand-review fold also has a Python replay (test_edges, test_scan)
    assert set(QUERIES) - set(ORACLES) == set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toArrow()
    want = duck.sql(ORACLES[name]).to_arrow_table()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_revenue" in df.columns
