"""Registered queries against their DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from tests.llm.conftest import SF
from lendscope.llm.queries import QUERIES, SQL


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(SQL[name])
    want = sorted(tuple(plain(v) for v in r) for r in rel.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(tuple(plain(r[c]) for c in rel.columns) for r in df.collect())
    assert len(got) == len(want)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_every_query_is_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(SQL) <= set(__spark_entry__.oracle_sql())
