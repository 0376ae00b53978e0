"""Numbers made in slices equal a plain count, also with hot keys, ties, nulls and no rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators.funnel import batch_numbers
from siftwell.operators.ranks import numbered, summed_before
from siftwell.schemas import RESULT_FIELDS
from siftwell.sinks.writers import group_index, result_blocks


def _made(n=2000):
    rng = random.Random(7)
    # one key holds a third of the rows, the first order column ties, and both have nulls
    return [(i, rng.choice([None, "hot", "hot", "a", "b", "c"]), rng.choice([None, 5.0, 5.0, rng.random() * 100])) for i in rng.sample(range(10 * n), n)]


def _place(row):
    return (row[2] is not None, row[2] or 0.0, row[0])


@pytest.mark.parametrize("slices", [1, 2, 64])
def test_numbers_equal_a_count(spark, slices):
    rows = _made()
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(5)
    whole = {r.id: r.n for r in numbered(df, ["v", "id"], "n", slices=slices).collect()}
    assert whole == {r[0]: n for n, r in enumerate(sorted(rows, key=_place))}
    by_key = {r.id: r.n for r in numbered(df, ["v", "id"], "n", ["k"], slices=slices).collect()}
    for key in (None, "hot", "a", "b", "c"):
        own = sorted((r for r in rows if r[1] == key), key=_place)
        assert [by_key[r[0]] for r in own] == list(range(len(own)))


def test_sums_and_batches(spark):
    rows = _made(300)
    df = spark.createDataFrame(rows, "id long, k string, v double")
    total, want = 0, {}
    for r in sorted(rows):
        want[r[0]], total = total, total + r[0]
    assert {r.id: r.s for r in summed_before(df, ["id"], "s", weight=F.col("id"), slices=16).collect()} == want
    hot = df.where("k = 'hot'").withColumnRenamed("id", "seq")
    made = sorted((r.seq, r.batch, r.id) for r in batch_numbers(hot, ["k"], ["seq"], 5).collect())
    assert [m[1:] for m in made] == [divmod(n, 5) for n in range(len(made))]


def test_no_rows(spark):
    assert numbered(spark.createDataFrame([], "id long, k string"), ["id"], "n", ["k"]).collect() == []


def test_groups_in_first_seen_order(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "a")], "seq long, g string")
    made = {r.seq: (r.group_name, r.group_size, r.out_index) for r in group_index(df, "g", "seq").collect()}
    assert made == {1: ("b", 2, 1), 3: ("b", 2, 2), 2: ("a", 2, 3), 5: ("a", 2, 4), 4: ("(unknown)", 1, 5)}


def test_result_blocks_are_numbered(spark):
    df = spark.createDataFrame([(9, "u2"), (4, "u1")], "seq long, post_url string").selectExpr("*", *(f"'' as {c}" for c in RESULT_FIELDS if c != "post_url"))
    blocks = {r.out_index: r.block for r in result_blocks(df).collect()}
    assert blocks[1].startswith("--- 1 ---\n") and "post_url: u1" in blocks[1] and "post_url: u2" in blocks[2]
