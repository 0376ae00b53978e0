"""Hard negatives against SQL over all pairs, with norms that let buckets be pruned, and the stated edge cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from siftwell.llm import hard_negatives as H

duckdb = pytest.importorskip("duckdb")
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
SMALL = {"bucket": 16, "span": 3, "block": 4}


def _sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return sorted(con.execute(H.TWIN).fetchall())


def _mined(spark, rows, **options):
    return sorted(map(tuple, H.mine(spark.createDataFrame(rows, VECTORS), **(SMALL | options)).collect()))


def _corpus(n=700, dim=6, hot=None):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((n, dim)) * rng.lognormal(0, 1.2, (n, 1))).astype(np.float32)
    x[::11] = x[5]  # ties: the smaller id goes first
    return [(i, [float(v) for v in x[i]], int(hot if hot is not None and i % 3 else i * 13 % 10)) for i in range(n)]


def test_many_blocks_and_spans_over_many_partitions(spark):
    rows = _corpus(1_500, hot=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _mined(spark, rows, bucket=20, span=2, block=3) == _sql(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("hot", [None, 4])
def test_equals_its_sql(spark, hot):
    rows = _corpus(hot=hot)
    got = _mined(spark, rows)
    assert got == _sql(rows) and len(got) > 50


def test_rows_that_take_no_part_and_repeats(spark):
    rows = _corpus(220)
    odd = [(1000, None, 1), (1001, [1.0, None, 0.0], 1), (1002, [float("nan")] * 6, 1), (1100, [float("inf")] * 6, 1), (1200, [9.0] * 6, None), (None, [9.0] * 6, 1)]
    assert _mined(spark, rows + odd + rows[:30]) == _sql(rows)
    assert _mined(spark, [*rows, (5000, [3e30] * 6, 1)]) == _sql(rows)  # its scores would not fit
    assert _mined(spark, [*rows, (5000, [], 1), (5001, [2.0, 2.0], 2), (5002, [2.0, 2.0, 0.0], 2)]) is not None


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + (i * 7919) % 1000 - 500), float((i * 31) % 17)], i % 3) for i in range(0, 300, 5)]
    assert _mined(spark, rows) == _sql(rows)


def test_empty_tables_lone_labels_and_other_columns(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []
    wide = T.StructType([*VECTORS, *(T.StructField(n, T.StringType()) for n in ("span", "norm", "a.b", "query"))])
    rows = _corpus(220)
    got = H.mine(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], wide), **SMALL).collect()
    assert sorted(map(tuple, got)) == _sql(rows)


def test_buckets_are_pruned_and_nothing_is_lost():
    rng = np.random.default_rng(1)
    v = np.floor(rng.standard_normal((4_000, 8)) * rng.lognormal(0, 2, (4_000, 1)) * 256)
    norm = np.linalg.norm(v, axis=1)
    rows = pd.DataFrame({"vec_id": np.arange(4_000), "label": np.arange(4_000) % 3, "v": list(v), "norm": norm})
    take = [7, 100, 2_000]
    queries = pd.DataFrame({"query": take, "own": take, "label": rows["label"].iloc[take].to_numpy(), "v": list(v[take]), "norm": norm[take], "low": [-(2**63)] * 3, "high": [2**63 - 1] * 3})
    found, reckoned = H.search_span(queries, rows, same=True, most=5, bucket=128)
    assert reckoned < 3 * 4_000 / 4
    for q in take:
        s = (v @ v[q]).astype(np.int64)
        want = sorted(((-s[k], k) for k in range(4_000) if k % 3 == q % 3 and k != q))[:5]
        own = found[found["query"] == q]
        assert sorted(zip(-own["score"], own["found"], strict=True)) == want
    low = queries.assign(low=int((norm[take] * norm.max()).max()) + 10**9)
    assert H.search_span(low, rows, same=False, most=5, bucket=128)[1] == 0
