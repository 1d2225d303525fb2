"""Every registered query with SQL agrees with DuckDB on the sf0.001 tables."""

import datetime
import math
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from lendscope import oracle
from lendscope.plans import catalog
from lendscope.sources.tables import TABLES

SF_SMALL = "/root/testdata/sf0.001"

# The library's own queries; those of the optional parts are tested beside them.
SQL = oracle.SQL
QUERIES = catalog.QUERIES


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.execute(SQL[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    for a, b in zip(gr, wr):
        assert a == pytest.approx(b) if all(isinstance(x, (int, float)) or x is None for x in a) else a == b


def test_every_query_has_sql_or_is_documented():
    no_sql = set(QUERIES) - set(SQL)
    assert no_sql <= set(E.ROWS_ONLY), no_sql


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 1


def test_registered_queries_include_the_librarys():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(E.ROWS_ONLY)))
def test_plan_has_no_cartesian_product_or_row_udf(spark, name, monkeypatch):
    """The plan of the result and of every table that is written on the way to it."""
    from lendscope import session
    plans, real = [], session.written

    def seen(df, table):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, table)

    for module in list(sys.modules.values()):
        if getattr(module, "__name__", "").startswith("lendscope") and getattr(module, "written", None) is real:
            monkeypatch.setattr(module, "written", seen)
    plans.append(QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert "CartesianProduct" not in plan
        assert "BatchEvalPython" not in plan
