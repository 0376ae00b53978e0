"""The history as keyed state: batches of any cut give what a plain fold gives."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from siftwell.streaming.feedback import EVENT, ROCKSDB, history_changes, history_now, history_of, profiles_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _events(n=1_500):
    draw = random.Random(5)
    out = []
    for seq in range(n):
        key = "hot" if draw.random() < 0.4 else f"https://x/{draw.randrange(60)}"
        if draw.random() < 0.3:
            out.append((key, seq, "label", draw.choice(["good", "BAD", "meh", None])))
        else:
            out.append((key, seq, "row", json.dumps({"company": f"Firm {draw.randrange(3)}", "poster": f" Poster {draw.randrange(8)}", "kept": draw.random() < 0.5})))
    return out + [(None, 1, "row", "{}"), ("never", 2, "label", "good"), ("empty", 3, "row", None), ("x", None, "row", "{}"), ("odd", 4, "other", "{}")]


def _plain(events):
    held = {}
    for key, _, kind, row in sorted((e for e in events if e[0] is not None and e[1] is not None), key=lambda e: e[1]):
        if kind == "row":
            held[key] = (held[key][0] if key in held else _, row, None)
        elif kind == "label" and key in held and (row or "").lower() in ("good", "bad"):
            held[key] = (*held[key][:2], row.lower())
    return held


def _as_map(df):
    rows = df.collect()
    assert len({r["key"] for r in rows}) == len(rows)
    return {r["key"]: (r["first_seq"], r["row"], r["label"]) for r in rows}


def test_one_aggregate_equals_the_fold(spark):
    events = _events()
    df = spark.createDataFrame(events, EVENT).repartition(5)
    assert _as_map(history_of(df)) == _plain(events)
    assert history_of(df.where("false")).count() == 0


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    yield spark
    spark.conf.set(PROVIDER, before)


def test_stream_equals_the_fold(rocks, tmp_path):
    spark, events = rocks, _events(900)
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def write(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(sink)

    for low, high in ((0, 200), (200, 210), (210, len(events))):
        spark.createDataFrame(events[low:high], EVENT).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).parquet(source)
        run = history_changes(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
    changes = spark.read.parquet(sink)
    assert _as_map(history_now(changes)) == _plain(events)
    whole = history_of(spark.createDataFrame(events, EVENT)).withColumn("sign", F.lit(1))
    assert sorted(profiles_of(changes).collect()) == sorted(profiles_of(whole).collect()) and profiles_of(changes).where("blocked").count() > 0
