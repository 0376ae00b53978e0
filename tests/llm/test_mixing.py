"""Source mixing against SQL that lists every quotient and block, and the cases its docstring states."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from siftwell.llm import mixing

duckdb = pytest.importorskip("duckdb")
DOCS = "doc_id long, source string, text string"


def _sql(rows, **options):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.execute(mixing.twin(**options)).fetchall(), key=repr)


def _mix(spark, rows, **options):
    return mixing.mix(spark.createDataFrame(rows, DOCS), **options)


def _plain(df):
    return sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


def _corpus():
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", " ".join(f"w{k}" for k in range(i * 37 % 211))) for i in range(300)]
    return [*rows, (None, None, "a b c"), (None, "hot", "x " * 500), (5, None, None), (6, "é", "\x0b\t "), (7, "empty", ""), (8, "hot", "y z q")]


@pytest.mark.parametrize("options", [{}, {"shard_words": 900, "block_words": 7}, {"weights": (5, 1), "share": 2.4, "ceiling": 3, "block_words": 16, "shard_words": 2_000}])
def test_equals_its_sql(spark, options):
    rows = _corpus()
    rows += rows[:20]  # repeated rows
    assert _plain(_mix(spark, rows, **options)) == _sql(rows, **options)


def test_targets_ceilings_and_reruns(spark):
    rows = _corpus()
    got = _mix(spark, rows, shard_words=3_000, block_words=8).collect()
    assert len(got) == len(rows)
    sources = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p["to"] - p["from"] for p in r.pieces)
        assert all(0 <= p["from"] < p["to"] <= r.size for p in r.pieces)
        sources.setdefault(r.source, [r.target, 2 * r.source_size, 0])[2] += r.taken
    assert sum(t for t, _, _ in sources.values()) == pytest.approx(1.5 * sum(c for _, c, _ in sources.values()) / 2)
    for target, most, taken in sources.values():
        shards = most / 2 // 3_000 + 1
        assert target <= most + 1e-9 and taken <= target + 4 and taken >= target - (8 * shards if target >= most - 1e-9 else 4)
    again = _mix(spark, list(reversed(rows)), shard_words=3_000, block_words=8).repartition(7)
    assert _plain(again) == sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got), key=repr)


def test_first_pass_before_the_second(spark):
    rows = [(i, "a", "w " * 40) for i in range(50)] + [(100 + i, "b", "w " * 40) for i in range(50)]
    got = _mix(spark, rows, weights=(1, 4), share=1.0, block_words=5).collect()
    assert all(r.taken <= r.size for r in got if r.source == "a")
    assert all(r.taken >= r.size - 5 for r in got if r.source == "b")


def test_empty_tables_and_clashing_names(spark):
    assert _mix(spark, []).count() == 0
    assert _plain(_mix(spark, [(1, "a", None), (2, None, " ")])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    names = T.StructType([T.StructField(n, T.StringType()) for n in ("a.b", "size", "target", "_source", "quota")])
    wide = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType()), *names])
    df = spark.createDataFrame([(1, "s", "one two three", "x", "9", "9", "z", "z")], wide)
    assert [(r.doc_id, r.size) for r in mixing.mix(df).collect()] == [(1, 3)]


def test_texts_of_the_mix(spark):
    rows = [(i, f"s{i % 2}", " ".join(f"d{i}w{k}" for k in range(60))) for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs, block_words=9)
    own = {k: t.split() for k, _, t in rows}
    pieces = {(r.doc_id, n): own[r.doc_id][p["from"] : p["to"]] for r in mixed.collect() for n, p in enumerate(r.pieces)}
    assert {(r.doc_id, r.part): r.text.split(" ") for r in mixing.mixed_texts(docs, mixed).collect()} == pieces


def test_one_very_long_text(spark):
    got = _mix(spark, [(1, "a", "word " * 200_000), (2, "b", "word " * 1_000)]).collect()
    assert {r.doc_id: r.size for r in got} == {1: 200_000, 2: 1_000} and sum(r.taken for r in got) == pytest.approx(301_500, abs=64)
