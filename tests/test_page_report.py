"""Counts of what pages are made of, beside plain Python."""

from __future__ import annotations

from collections import Counter

from siftwell.sources.report import most_frequent, name_counts, page_facts

PAGE = """<html><body><!-- x --><div class="feed-list  feed-list" data-urn="urn:li:activity:1" id=a><p class="b">We are <b>Hiring</b> now</p><p>an intern<br></p><span>an INTERN</span></div>
<div data-id="no" data-entity-urn='urn:li:ugcPost:2' class="b"><i></i></div><script class="post-js">"<p>hiring</p>"</script></body></html>"""


def test_facts(spark):
    rows = spark.createDataFrame([(1, PAGE, 9), (2, "", 9), (3, None, 9), (4, "hiring", 9)], "page_id int, html string, `a.b` int")
    out = page_facts(rows)
    assert out.columns == ["page_id", "a.b", "n_elements", "n_carriers", "n_hiring", "body_chars"]
    got = {r[0]: tuple(r)[2:] for r in out.collect()}
    # leaves that say so: the b, the span and the script
    assert got[1] == (11, 2, 3, len("We are Hiring now an intern an INTERN")) and got[2] == got[3] == (0, 0, 0, 0) and got[4] == (0, 0, 0, 6)


def test_names(spark):
    pages = spark.createDataFrame([(k, PAGE) for k in range(300)] + [(k, f'<p data-id="activity:{k}" class="post-{k % 60}">') for k in range(300, 900)] + [(901, None)], "page_id int, html string")
    counts = name_counts(pages.repartition(7))
    got = {(r["scope"], r["name"]): r["n"] for r in counts.collect()}
    want = Counter({("carrier_class", "feed-list"): 600, ("carrier_class", "b"): 300, ("carrier_attribute", "data-urn"): 300, ("carrier_attribute", "data-entity-urn"): 300, ("carrier_attribute", "data-id"): 900, ("carrier_attribute", "id"): 300, ("carrier_attribute", "class"): 1_200, ("class", "feed-list"): 600, ("class", "post-js"): 300})
    want.update({(scope, f"post-{k}"): 10 for k in range(60) for scope in ("carrier_class", "class")})
    assert got == dict(want)
    shown = [(r["scope"], r["name"], r["n"]) for r in most_frequent(counts).collect()]
    best = sorted(((s, n, c) for (s, n), c in want.items()), key=lambda x: (-x[2], x[1]))
    assert set(shown) == {x for scope, most in (("carrier_class", 25), ("carrier_attribute", 25), ("class", 40)) for x in [b for b in best if b[0] == scope][:most]}
    assert most_frequent(name_counts(pages.where("false"))).count() == 0
