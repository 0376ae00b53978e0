"""Extra columns with dots, quotes and the operators' own names pass through every stage unchanged."""

from __future__ import annotations

import pytest

from siftwell.llm import decontaminate, pii, quality, simhash, toxicity

LEAK = "the quick brown fox jumps over the lazy dog while seven wizards brew a bitter potion"
ODD = ["a.b", "score", "spans", "_own_score", "_1", "x`y", "item_id", "component_id", "fp", "gone", "pii", "text.len"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a calm and sunny morning by the river", *map(str, range(len(ODD)))), (2, f"so {LEAK} indeed", *[None] * len(ODD)), (3, None, *["v"] * len(ODD)), (4, "", *["w"] * len(ODD))]
    names = ["doc_id", "text", *ODD]
    quote = lambda c: "`" + c.replace("`", "``") + "`"
    return spark.createDataFrame(rows, ", ".join(f"{quote(c)} {'int' if c == 'doc_id' else 'string'}" for c in names))


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_filters_keep_columns(spark, docs):
    items = spark.createDataFrame([(7, LEAK)], "item_id long, text string")
    model = toxicity.train([(f"you are a fool and number {k}", 1) for k in range(30)] + [(f"kind words on day {k}", 0) for k in range(30)])
    clean = decontaminate.without_leaks(docs, items)
    assert clean.columns == docs.columns and _sorted(clean) == [r for r in _sorted(docs) if r[0] != 2]
    for kept in (toxicity.without_toxic(docs, model, 1.1), decontaminate.without_leaks(docs, items.where("false"))):
        assert kept.columns == docs.columns and _sorted(kept) == _sorted(docs)
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and _sorted(one) == [r for r in _sorted(docs) if r[0] != 4]
    assert pii.mask_pii(docs).columns == docs.columns


def test_scores_are_added(spark, docs):
    sample = [(f"word{k} fine prose of some length", 1) for k in range(30)] + [(f"junk {k} click", 0) for k in range(30)]
    scored = quality.score_documents(docs, quality.train(sample, share=0.5))
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"] and scored.count() == 4
    assert [r[2] for r in _sorted(scored)] == [r[2] for r in _sorted(docs)]
