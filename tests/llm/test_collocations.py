"""Phrase collocations against SQL that lists every phrase, with shards, slices and filters forced small."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from siftwell.llm import collocations as C

duckdb = pytest.importorskip("duckdb")
DOCS = "lang string, text string"


def _sql(rows, **options):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(C.twin(**options)).fetchall())


def _mined(spark, rows, **options):
    return sorted(map(tuple, C.mine(spark.createDataFrame(rows, DOCS).repartition(3), **options).collect()))


def _corpus(n=120, seed=2):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "a\x01", "new york", "ab", "abc", "\x00", "x-y", " ", *(f"w{k}" for k in range(25))]
    weights = [30, 5, 20, 4, 2, 3, 3, 4, 4, 2, 2, 1, *([2] * 25)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 80)):
            parts.append(rng.choice(["new york city hall", "the end of the", "a a a a"]) if rng.random() < 0.1 else rng.choices(words, weights)[0])
            parts.append(rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", " \r"]))
        rows.append(([None, "und", "en", "en", "en", "de"][k % 6], "".join(parts)))
    return rows


def test_equals_its_sql(spark):
    rows = _corpus()
    rows += [("en", None), (None, ""), ("fr", "..."), *rows[:10]]
    got = _mined(spark, rows)
    assert got == _sql(rows) and len({r[0] for r in got}) == 3 and any(" " in r[2][r[2].index(" ") + 1 :] for r in got)


@pytest.mark.parametrize("options", [{"least": 3, "first": 40}, {"least": 5, "absorbed": 50}])
def test_small_shards_cut_texts_slices_and_a_full_filter(spark, monkeypatch, options):
    for name, value in (("TOKENS", 50), ("WORDS", 20), ("STRETCH", 16), ("SLICES", 7), ("FEWEST_BITS", 64), ("MOST_BITS", 64)):
        monkeypatch.setattr(C, name, value)
    rows = _corpus(60, seed=5)
    assert _mined(spark, rows, **options) == _sql(rows, **options)


def test_long_text_is_split_between_words(monkeypatch):
    monkeypatch.setattr(C, "TOKENS", 10)
    monkeypatch.setattr(C, "STRETCH", 8)
    text = "one two three four five six " * 20 + "end. one two"
    counts = {}
    shard = C._Shard((0, 1, 2, 3, 4), None)
    for batch in [*shard.add("en", text), *shard.flush()]:
        for r in batch.to_pylist():
            counts[r["phrase"]] = counts.get(r["phrase"], 0) + r["f"]
    words, want = ["one", "two", "three", "four", "five", "six"] * 20 + ["end"], {"": 123, "one": 21, "two": 21, "one two": 21}
    for k in range(1, 5):
        for i in range(len(words) - k + 1):
            p = " ".join(words[i : i + k])
            want.setdefault(p, sum(words[j : j + k] == words[i : i + k] for j in range(len(words) - k + 1)))
    assert counts == want


def test_filter_never_loses_a_pair(spark, monkeypatch):
    pairs = [("en", f"a{i} b{i * 7 % 50}") for i in range(500)]
    bits = C._Pairs(C._filter_bits(spark.createDataFrame(pairs, "lang string, phrase string")))
    import numpy as np

    words = [p.split(" ") for _, p in pairs]
    h = lambda k: C._hashes(np.array([w[k] for w in words], dtype=object))
    lang = C._hashes(np.array(["en"] * len(pairs), dtype=object))
    assert bits.holds(C._mixed(h(0) + lang, h(1))).all()
    assert bits.holds(C._mixed(h(1) + lang, h(0))).mean() < 0.1


def test_empty_tables_and_other_columns(spark):
    assert _mined(spark, []) == [] and _mined(spark, [("en", "too few words here")]) == []
    wide = T.StructType([T.StructField(n, T.StringType()) for n in ("lang", "text", "phrase", "f", "a.b", "depth")])
    rows = _corpus(40)
    got = C.mine(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], wide), least=10).collect()
    assert sorted(map(tuple, got)) == _sql(rows, least=10)
