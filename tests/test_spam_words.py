"""Words that spam patterns can't do without, against the plain patterns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from siftwell.functions.text import without_hashtags
from siftwell.operators.provenance import _NEEDED, _found, _low, _may

HITS = (
    "DM me for a referral", "refer a friend, message me", "Join our Discord", "WhatsApp group", "telegram channel", "I’m hiring, dm me", "dm me if you look for an INTERNship",
    "\n1. SDE intern\n2. ML role", "- opening\n\n• hiring x", "referral farmer", "job aggregator", "Daily Job Alert", "jobscan", "follow for more jobs", "mass hiring", "multiple hiring alerts",
    "Latest tech opening", "top openings", "job roundup", "Acme Labs is hiring", "Zeta hiring", "Company: Acme | x", "\n company :\tZeta",
)


def test_texts_that_hold_no_needed_word_never_match(spark):
    rng = random.Random(7)
    odd = lambda t: "".join(rng.choice({"s": "sSſ", "i": "iIıİ", "k": "kKK"}.get(c.lower(), c.lower() + c.upper() + c)) for c in t)
    texts = [*HITS, "", "plain", *(odd(t) for t in HITS * 20), *(" ".join(rng.sample(HITS, 2))[rng.randint(0, 9) :] for _ in range(100))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = list(_NEEDED)
    body, low = F.col("t"), _low(F.col("t"))
    rows = df.select("t", *(F.struct(body.rlike(p).alias("plain"), _found(body, low, p).alias("found"), _may(low, p).alias("may")).alias(f"p{k}") for k, p in enumerate(patterns))).collect()
    for k, p in enumerate(patterns):
        assert [r["t"] for r in rows if r[f"p{k}"]["plain"] != r[f"p{k}"]["found"]] == []
        assert sum(r[f"p{k}"]["plain"] for r in rows) >= 2 and not all(r[f"p{k}"]["may"] for r in rows), p


def test_hashtags_go_as_by_the_plain_pattern(spark):
    df = spark.createDataFrame([(t,) for t in ("#a b", "x#a", "##a #b#c", "é#a ü #é_1!", "# a", "", "a #", "#a#b ##")], "t string")
    assert df.where(without_hashtags(F.col("t")) != F.regexp_replace("t", r"(?U)(?<!\w)#\w+", "")).collect() == []
