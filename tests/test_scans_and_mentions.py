"""Cut scans against a plain loop, and mentions against a search of every name in every text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators.scans import cut_scan, scan_listings
from siftwell.operators.walks import mention_join

ROUNDS = "scan string, round int, cards long, wall boolean, age double"


def _rounds(n=40, seed=4):
    rng = random.Random(seed)
    return [(f"s{k}", r, rng.choice([0, 3, 3, 3, 4]), rng.random() < 0.04, rng.random() * 10 + r / 3) for k in range(n) for r in range(200 if k == 0 else rng.randint(0, 12))]


def _loop(rows, most):
    out, scans = set(), {}
    for row in rows:
        scans.setdefault(row[0], []).append(row)
    for own in scans.values():
        kept, reason, before, flat = [], "end", 0, 0
        for _, r, cards, wall, age in own:
            if wall:
                reason = "login"
                break
            kept.append(r)
            flat = flat + 1 if cards > 0 and cards == before else 0
            before = cards
            if age > 12 or flat >= 2 or r >= most - 1:
                reason = "age" if age > 12 else "stagnant" if flat >= 2 else "rounds"
                break
        out |= {(own[0][0], r, reason) for r in kept}
    return out


def _cut(spark, rows, most):
    df = spark.createDataFrame(rows, ROUNDS)
    return cut_scan(df, ["scan"], "round", before=[("login", F.col("wall"))], after=[("age", F.col("age") > 12)], loaded="cards", most_rounds=most)


@pytest.mark.parametrize("most", [5, 150])
def test_scan_stops_where_a_loop_would(spark, most):
    rows = _rounds()
    assert {(r.scan, r["round"], r.stopped_by) for r in _cut(spark, rows, most).collect()} == _loop(rows, most)
    rows = [("hot", r, r + 1, False, 0.0) for r in range(3_000)] + rows[:50]
    assert {(r.scan, r["round"], r.stopped_by) for r in _cut(spark, rows, 10_000).collect()} == _loop(rows, 10_000)


def test_empty_scans_and_null_keys(spark):
    assert _cut(spark, [], 5).count() == 0
    assert _cut(spark, [(None, 0, 1, False, 0.0), ("a", 0, None, None, None)], 5).select("scan", "stopped_by").collect() == [("a", "end")]


def test_listings_of_kept_rounds(spark):
    link = "https://x/jobs/view/{}/"
    cards = [("a", 0, 0, "t", "c", "", link.format(1)), ("a", 0, 1, "t", "c", "", link.format(1)), ("a", 1, 0, "t", "c", "", ""), ("a", 1, 1, "t", "c", "", ""), ("a", 2, 0, "u", "c", "", link.format(2)), ("a", 3, 0, "u", "c", "", link.format(3))]
    cards = spark.createDataFrame(cards, "scan string, round int, pos int, title string, company string, location string, link string")
    rounds = spark.createDataFrame([("a", n) for n in range(3)], "scan string, round int")
    got = sorted((r["round"], r.pos) for r in scan_listings(cards, rounds, ["scan"], "round", "pos").collect())
    assert got == [(0, 0), (1, 0), (2, 0)]
    assert scan_listings(cards, rounds, ["scan"], "round", "pos", most=2).count() == 2


NAMES = ["Acme", "Acme Labs", "New York Times", "York", "Times", "Straße", "東京", "a", "Zeta Inc", "", "  ", None, "acme", "x-y z"]
TEXTS = ["Acme labs and the new-york times", "acmelabs", "東京 and  STRASSE straße", None, "", "zeta, inc. x y z", "a" * 10_000, "york york acme", "new york"]


@pytest.mark.parametrize("most_names", [1_000, 2])
def test_mentions_by_automaton_and_by_first_word(spark, most_names):
    posts = spark.createDataFrame([*enumerate(TEXTS * 3), (0, TEXTS[0])], "id int, text string")
    names = spark.createDataFrame([(n,) for n in NAMES * 2], "target string")
    got = mention_join(posts, "id", F.col("text"), names, most_names=most_names).collect()
    assert len(got) == len({tuple(r) for r in got})
    from siftwell.functions.entities import fold_company, folded
    from siftwell.operators.walks import _wide

    cores = [(r[0], r[1] or "", r[2]) for r in names.distinct().where("target is not null").select("target", fold_company(F.col("target")), _wide(F.col("target"))).collect()]
    texts = posts.select("id", folded(F.coalesce("text", F.lit(""))), _wide(F.coalesce("text", F.lit("")))).collect()
    want = {(i, n) for i, a, w in texts for n, core, wide in cores if (core and f" {core} " in f" {a} ") or (not core and wide and f" {wide} " in f" {w} ")}
    assert {tuple(r) for r in got} == want and len(want) > 12


@pytest.mark.parametrize("most_names", [1_000, 0])
def test_mentions_of_nothing(spark, most_names):
    none = spark.createDataFrame([], "id int, text string")
    names = spark.createDataFrame([("Acme",)], "target string")
    assert mention_join(none, "id", F.col("text"), names, most_names=most_names).count() == 0
    some = spark.createDataFrame([(1, "acme")], "id int, text string")
    assert mention_join(some, "id", F.col("text"), names.where("false"), most_names=most_names).count() == 0


@pytest.mark.parametrize("most_names", [1_000, 0])
def test_names_that_are_no_companies_keep_all_words(spark, most_names):
    from siftwell.functions.entities import folded

    posts = spark.createDataFrame([(1, "of la here"), (2, "of La-AI here"), (3, "la company ai")], "id int, text string")
    names = spark.createDataFrame([("la ai",), ("la company",)], "target string")
    of = lambda **fold: {tuple(r) for r in mention_join(posts, "id", F.col("text"), names, most_names=most_names, **fold).collect()}
    assert of(fold=folded) == {(2, "la ai"), (3, "la company")}
    assert of() == {(k, name) for k in (1, 2, 3) for name in ("la ai", "la company")}


def test_mentions_of_documents_whose_items_begin_like_companies(spark, tmp_path):
    from siftwell.plans import registry

    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, "la group here"), (2, "La-AI, here"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("la ai is an item",), ("La Group",), ("la",), (None,)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = set(con.execute(registry.oracle_sql()["mentions_of_documents"]).fetchall())
    assert {tuple(r) for r in registry.queries()["mentions_of_documents"](spark, str(tmp_path)).collect()} == want == {(1, "la group"), (1, "la"), (2, "la ai"), (2, "la")}
