"""Personal data in long texts: cost in proportion to the text, spans of every match, columns of the caller."""

from __future__ import annotations

import re
import time

from siftwell.llm import pii


def _text(n):
    return " ".join(f"line {k} mail user{k}@example.org or see the notes" for k in range(n))


def _seconds(spark, n):
    df = spark.createDataFrame([(1, _text(n))], "doc_id int, text string")
    began = time.perf_counter()
    spans, masked = pii.find_pii(df).first()["pii"], pii.mask_pii(df).first()["text"]
    took = time.perf_counter() - began
    want = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _text(n))]
    assert [(s["start"], s["end"]) for s in spans if s["kind"] == "email"] == want and len(want) == n
    assert masked.count("[EMAIL]") == n and "@" not in masked
    return took


def test_a_megabyte_of_addresses(spark):
    _seconds(spark, 100)
    short = _seconds(spark, 10_000)
    assert _seconds(spark, 20_000) < max(3.5 * short, 10)


def test_columns_of_the_caller_stay_and_rows_repeat(spark):
    row = ("mine", "x", "write a@b.co", None)
    df = spark.createDataFrame([row, row, ("mine", "x", None, None), ("mine", "x", "", None)], "_email string, `a.b` string, text string, pii string")
    rows = pii.find_pii(df).collect()
    assert [r["_email"] for r in rows] == ["mine"] * 4 and [len(r["pii"]) for r in rows] == [1, 1, 0, 0]
    assert [r["text"] for r in pii.mask_pii(df).collect()] == ["write [EMAIL]"] * 2 + [None, ""]
