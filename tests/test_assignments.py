"""Stray permalinks, embed blobs, the cache of classes, prompt blocks: hot keys, empty tables, reruns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions.urls import activity_id_in_html, embedded_permalink
from siftwell.operators.classes import merged, pending, read_replies
from siftwell.operators.verdicts import post_block, quoted_text
from siftwell.operators.walks import assign_strays

ID = "7489706814855344128"
CACHE = "name_key string, name string, category string, confidence string, source string"


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first()["o"]


def test_strays_need_one_post_and_one_urn(spark):
    link = f'<a href="/feed/update/urn:li:ugcPost:{ID}/">'
    pages = spark.createDataFrame([(1, link), (2, link), (3, link * 2), (4, "no"), (5, link), (6, None), (7, link), (None, link)], "page int, html string")
    posts = [(1, "a", ""), (1, "b", "https://x/1"), (2, "c", ""), (2, "d", None), (3, "e", ""), (4, "f", ""), (6, "g", None), (7, "h", "https://x/2"), (None, "i", ""), *((5, f"r{k}", "https://x/3") for k in range(5_000)), (5, "open", "")]
    got = {r["name"]: (r["post_url"], r["stray"]) for r in assign_strays(spark.createDataFrame(posts, "page int, name string, post_url string"), pages, "page").collect()}
    want = f"https://www.linkedin.com/feed/update/urn:li:ugcPost:{ID}/"
    assert len(got) == len(posts) and {n for n, (_, s) in got.items() if s} == {"a", "open"} and got["a"][0] == got["open"][0] == want
    assert got["b"][0] == "https://x/1" and got["d"] == ("", False) and got["i"] == ("", False)
    none = spark.createDataFrame([], "page int, name string, post_url string")
    assert assign_strays(none, pages, "page").count() == 0 and assign_strays(spark.createDataFrame(posts, none.schema), pages.where("false"), "page").where("stray").count() == 0


def test_embed_blobs_and_ids_in_markup(spark):
    for kind, shown in (("share", "share"), ("ugcpost", "ugcPost"), ("activity", "activity")):
        blob = f'<iframe src="https://www.linkedin.com/embed/feed/update/urn%3Ali%3A{kind}%3A{ID}?a=1&amp;b=2">'
        assert _one(spark, embedded_permalink, blob) == f"https://www.linkedin.com/feed/update/urn:li:{shown}:{ID}/"
    assert _one(spark, embedded_permalink, "urn:li:share:12") == "" and _one(spark, embedded_permalink, "") == "" and _one(spark, embedded_permalink, "100% no") == ""
    assert _one(spark, activity_id_in_html, f"<div data-urn='urn:li:activity:{ID}'><a class=x href='/in/a'></a><a href='/feed/update/urn%3Ali%3Aactivity%3A{ID}/'>") == ID
    assert _one(spark, activity_id_in_html, f'<div data-urn="urn:li:activity:{ID}"></div>') == ""


def test_only_missing_names_are_asked_for_and_merging_again_changes_nothing(spark):
    names = spark.createDataFrame([(k, f" Firm {k % 70} ") for k in range(300)] + [(400, "FIRM 3"), (401, "hot")] + [(500 + k, "Hot") for k in range(2_000)] + [(9_000, None), (9_001, "  ")], "seq long, name string")
    cache = spark.createDataFrame([("firm 0", "Firm 0", "unknown", "low", "old")], CACHE)
    asked = pending(names, cache)
    rows = asked.orderBy("batch", "id").collect()
    assert [r["name"] for r in rows] == [f"Firm {k}" for k in range(1, 70)] + ["hot"] and [(r["batch"], r["id"]) for r in rows] == [(k // 25, k % 25) for k in range(70)]
    replies = [(0, '{"results": [{"company": "FIRM 1", "category": "Funded_Startup", "confidence": "high"}, {"company": "firm 2", "category": "farm"}, {"company": "Firm 0", "category": "funded_startup"}, {"company": "New Co", "category": "unknown"}, {"company": ""}]}'), (1, "sorry"), (2, '[{"company": "Firm 1", "category": "education_or_training", "confidence": "sure"}]'), (3, None)]
    found = read_replies(spark.createDataFrame(replies, "batch long, reply string"), asked)
    once = merged(cache, found)
    got = {r["name_key"]: (r["name"], r["category"], r["confidence"], r["source"]) for r in once.collect()}
    assert len(got) == 72 and got["firm 0"][3] == "old" and got["firm 1"] == ("Firm 1", "education_or_training", "low", "model-guess") and got["firm 2"][1:3] == ("unknown", "low") and got["new co"][0] == "New Co" and got["hot"][1] == "unknown"
    assert sorted(merged(once, found).collect()) == sorted(once.collect()) and pending(names, once).count() == 0
    nothing = names.where("false")
    assert pending(nothing, cache).count() == 0 and read_replies(spark.createDataFrame([], "batch long, reply string"), pending(nothing, cache)).count() == 0


def test_prompt_block(spark):
    assert [_one(spark, quoted_text, v) for v in ("a", "it's", 'it\'s "x"', "a\nb\\", None)] == [repr("a"), repr("it's"), repr('it\'s "x"'), repr("a\nb\\"), "''"]
    df = spark.createDataFrame([(3, "Acme", ["u1", "", "u2"], "j", "x" * 700, None)], "id int, company string, outbound_links array<string>, job_link string, post_text string, engagement map<string,bigint>")
    lines = df.select(post_block(df).alias("b")).first()["b"].split("\n")
    assert lines[0] == "[3] target_company='Acme' poster='' headline='' role='' link_class=''" and lines[1] == "link_categories: []" and lines[3] == "engagement: {}"
    assert lines[6] == "links: j; u1, u2" and lines[7] == "text: " + "x" * 599 + "…" and len(lines) == 8
