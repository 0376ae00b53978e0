"""Lists of openings: equal to the plain pattern on short texts, linear on long ones."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from siftwell.operators.provenance import NAMED_FIELD, ROLE_DUMP, roundup_signals

#: Fixed value: what two listed openings look like.
PLAIN = re.compile(r"(?:(?:^|\n)\s*(?:\d+[\).]|[-•]|[1-9]️⃣)\s*.{0,90}(?:intern|opening|hiring|role).*){2,}", re.IGNORECASE)


def test_equals_the_plain_pattern(spark):
    draw = random.Random(3)
    pieces = ["\n", "\n- role", "\n\n2) a role", "\r\n", " ", "\t", "- ", "-", "• ", "1. ", "12) ", "3️⃣ ", "3", "role", "Hiring", "an intern", "openin", "x" * 60, "y" * 31, "."]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 14))) for _ in range(4_000)] + ["", "- role\r\n- role", "-\n1. role\n\n \n2. ROLE", "x - role\n- role", f"- {'x' * 90}role\n- role", f"- {'x' * 91}role\n- role"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.col("t").rlike(ROLE_DUMP).alias("hit")).collect()
    got = {r["i"]: r["hit"] for r in rows}
    assert [t for i, t in enumerate(texts) if got[i] != bool(PLAIN.search(t))] == [] and 400 < sum(got.values()) < 3_600


def test_long_texts(spark):
    listed, blank, dashes = "- a role for an intern with hiring openings\n" * 25_000, "\n" * 1_000_000, "-\n" * 500_000
    near = ("- " + "intern " * 13 + "\nx\n") * 10_000
    began = time.monotonic()
    rows = spark.createDataFrame([(0, listed), (1, blank), (2, dashes), (3, near), (4, None), (5, "")], "i int, t string").select("i", F.array_contains(roundup_signals(F.coalesce("t", F.lit(""))), "multi-role-dump").alias("hit")).collect()
    assert {r["i"] for r in rows if r["hit"]} == {0} and time.monotonic() - began < 60
    assert spark.createDataFrame([], "t string").where(F.col("t").rlike(ROLE_DUMP)).count() == 0


def test_company_fields_equal_the_plain_pattern(spark):
    plain = re.compile(r"(?:^|\n)\s*company\s*:\s*([^\n|#]+)", re.IGNORECASE)
    draw = random.Random(4)
    pieces = ["\n", "\n\n ", "company", "Company: ", "company :", " Acme", "|", "#", ":", " ", "\t", "x"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(3_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.regexp_extract_all("t", F.lit(NAMED_FIELD), F.lit(1)).alias("names")).collect()
    assert [texts[r["i"]] for r in rows if r["names"] != plain.findall(texts[r["i"]])] == [] and sum(bool(r["names"]) for r in rows) > 200
