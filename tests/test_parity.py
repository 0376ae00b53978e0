"""Every registered query against its DuckDB twin on the small tables."""

from __future__ import annotations

import math
import os

import pytest

from siftwell.plans import registry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def _key(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_key(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(registry.cases()))
def test_case_has_its_answer(spark, con, name):
    f, answer = registry.cases()[name]
    df, cur = f(spark, DATA), con.execute(answer)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(names, cur.fetchall())


def test_every_query_has_a_twin():
    assert registry.queries().keys() == registry.oracle_sql().keys()
    assert not registry.queries().keys() & registry.cases().keys()
