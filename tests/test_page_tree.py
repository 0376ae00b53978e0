"""The tree of a page, selection by intervals, and the records of cards."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftwell.sources import html
from siftwell.sources.tree import Rule, all_of, below, decoded, first_of_rule, inner_text, nodes_of, outermost, read_nodes, text_content

AS_OF = "2024-01-31 00:00:00"
ID = "7489706814855344128"
ACTIVITY = f"""<div role="listitem" data-urn="urn:li:activity:{ID}" data-chameleon-result-urn="urn:li:activity:{ID}">
  <div class="update-components-actor__sub-description"><a href="https://www.linkedin.com/feed/update/urn:li:activity:{ID}/">2h</a></div>
  <p>We're hiring software interns at Acme. Apply now.</p></div>"""
RESHARE = f"""<div role="listitem" componentkey="FLAGSHIP_SEARCH_RESULT"><span aria-labelledby="e">Reshare</span>
  <div class="feed-shared-actor__sub-description"><a href="/feed/update/urn%3Ali%3Aactivity%3A{ID}/?reshareId=1">1d</a></div>
  <div data-finite-scroll-hotkey-item="urn:li:fsd_update:(urn:li:activity:9998887776665554444,BLENDED,EMPTY)">Not this one.</div></div>"""
FULL = """<li role="listitem" componentkey="x-FLAGSHIP_SEARCH-1"><div><a href="/company/acme/?trk=1">logo</a>
  <button aria-label="Open control menu for post by Asha Rao 2nd">..</button>
  <span>SWE @ Globex · 1,200 followers · Verified</span><p>3d • <svg aria-label="Visibility: Global"></svg></p></div>
  <script>var x = "<b>12 comments</b>"</script>
  <div data-testid="expandable-text-box">We are hiring<br>5 Day Training <a href="/feed/update/urn:li:activity:1111111111111111111/">2d</a> see https://acme.com/jobs.
    <ul><li>one<li>two</ul></div>
  <a href="/safety/go/?url=https%3A%2F%2Flnkd.in%2Fabc">apply</a><a href="/jobs/view/77/?x=1">job</a>
  <div class="update-components-entity"><div class="update-components-entity__title"><span aria-hidden="true">ML Intern</span>ML Intern</div>
    <div class="update-components-entity__subtitle">Initech</div><div class="update-components-entity__caption">Pune</div></div>
  <div>1,024 reactions</div><div>12 comments</div></li>"""


def _records(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    return html.post_fields(html.post_cards(df), F.lit(AS_OF)).orderBy("page_id", "card_index").collect()


def test_intervals_nest_and_order():
    page = '<!doctype html><!-- <b> --><div a=1 A=2><p>x<p>y &amp; <i>z</b></i><ul><li>1<li>2</ul><br><img src="a>b"></div>tail<script>if (a<b) {"</p>"}</script></x><td'
    nodes = read_nodes(page)
    assert [n["at"] for n in nodes] == list(range(len(nodes)))
    for n in nodes:
        assert all(m["end"] <= n["end"] for m in nodes[n["at"] : n["end"]])
    tags = [(n["tag"], n["text"]) for n in nodes if n["tag"] != "#line"]
    assert tags == [("div", ""), ("p", ""), ("#text", "x"), ("p", ""), ("#text", "y & "), ("i", ""), ("#text", "z"), ("ul", ""), ("li", ""), ("#text", "1"), ("li", ""), ("#text", "2"), ("br", ""), ("img", ""), ("#text", "tail"), ("script", ""), ("#data", 'if (a<b) {"</p>"}'), ("#text", "<td")]
    assert nodes[1]["attrs"] == {"a": "1"} and next(n for n in nodes if n["tag"] == "img")["attrs"] == {"src": "a>b"}
    assert read_nodes(None) == [] and read_nodes("") == [] and len(read_nodes("<div>" * 5_000)) == 15_000


def test_selection_and_text(spark):
    page = '<div class="a b"><span class="a">one<span aria-hidden="true">two</span></span></div><div class="ab">three<script>no</script></div>'
    df = spark.createDataFrame([(page,), (None,)], "html string").select(nodes_of(F.col("html")).alias("n"))
    n = F.col("n")
    a = Rule(css_class="a")
    r = df.select(F.size(all_of(n, a)).alias("all"), F.size(outermost(all_of(n, a))).alias("outer"), text_content(below(n, first_of_rule(n, Rule(("span",), attrs=(("aria-hidden", "=", "true"),), within=Rule(("span",), "a"))))).alias("inner"), inner_text(n).alias("shown"), F.size(all_of(n, Rule(("div",), holds=a))).alias("holds")).collect()
    assert (r[0]["all"], r[0]["outer"], r[0]["inner"], r[0]["holds"]) == (2, 1, "two", 1)
    assert r[0]["shown"].split("\n") == ["", "onetwo", "", "three", ""] and r[1]["all"] == 0 and r[1]["shown"] == ""


def test_permalink_comes_from_the_anchor(spark):
    first, second = _records(spark, ACTIVITY, RESHARE)
    want = f"https://www.linkedin.com/feed/update/urn:li:activity:{ID}/"
    assert (first.post_url, first.activity_urn, first.days_old, first.post_date) == (want, f"urn:li:activity:{ID}", 2 / 24, "2h ago")
    assert "We're hiring software interns at Acme. Apply now." in first.post_text
    assert (second.post_url, second.days_old) == (want, 1.0) and second.reasons == ["post_url:exact"]
    (bare,) = _records(spark, '<div data-chameleon-result-urn="urn:li:activity:5556667778889990000"><p>We are hiring.</p></div>')
    assert (bare.post_url, bare.activity_urn, bare.post_text) == ("", "", "We are hiring.")


def test_every_field_of_a_card(spark):
    (r,) = _records(spark, f"<ul>{FULL}</ul>")
    assert (r.poster, r.role, r.company, r.location) == ("Asha Rao", "ML Intern", "Initech", "Pune")
    assert r.post_text == "We are hiring 5 Day Training 2d see https://acme.com/jobs. one two"
    assert (r.days_old, r.post_date) == (3.0, "3d ago") and r.poster_headline == "logo .. SWE @ Globex · 1,200 followers · Verified 3d • var x = \"<b>12 comments</b>\""
    assert (r.follower_count, r.poster_verified, r.engagement) == (1200, True, {"likes": 1024, "comments": 12, "reposts": 0})
    assert r.job_link == "https://www.linkedin.com/jobs/view/77/" and r.post_url == "" and r.actor_url == "https://www.linkedin.com/company/acme/"
    assert r.outbound_links[-1] == "https://acme.com/jobs" and "https://lnkd.in/abc" in r.outbound_links and r.reasons == ["company:job-card"]


def test_company_by_source_and_last_resort(spark):
    card = '<div class="feed-shared-update-v2">{}</div>'
    rows = _records(
        spark,
        card.format('<a href="/company/x/">c</a><span class="feed-shared-actor__name">Umbrella</span><div class="update-components-text">Hello</div>'),
        card.format('<span class="feed-shared-actor__name">Ravi</span><span>Engineer at Hooli</span><div data-testid="expandable-text-box">Hi</div>'),
        card.format('<div class="update-components-text">Company: Stark | x</div>'),
        card.format("<p>Only Name 2nd</p><p>4h</p><p>Text here</p>"),
        card.format("  "),
        "",
    )
    assert [(r.page_id, r.company, r.reasons) for r in rows[:3]] == [(0, "Umbrella", ["company:company-page"]), (1, "Hooli", ["company:poster-headline"]), (2, "Stark", ["company:post-body"])]
    assert (rows[3].poster, rows[3].post_text, len(rows)) == ("Only Name", "Only Name 2nd 4h Text here", 4)


def test_containers(spark):
    many = "".join(f'<div class="fie-impression-container"><p>post {k}</p></div>' for k in range(300))
    rows = _records(spark, f'<div data-view-name="feed-full-update">{many}</div>', '<article data-id="urn:li:share:1"><section data-urn="urn:li:activity:2"><p>in</p></section></article><article data-id="urn:li:ugcPost:3">out</article>', "<p>nothing</p>")
    assert [r.page_id for r in rows].count(0) == 300 and rows[299].post_text == "post 299"
    assert [(r.page_id, r.post_text) for r in rows[300:]] == [(1, "in"), (1, "out")]


def test_job_cards(spark):
    card = '<li class="scaffold-layout__list-item"><a class="job-card-list__title" href="/jobs/view/5/?x"><b>SDE</b></a><div class="artdeco-entity-lockup__subtitle">Acme Acme</div><ul class="job-card-container__metadata-wrapper"><li>Pune</li></ul></li>'
    blank = '<li class="scaffold-layout__list-item"><a href="/jobs/view/6/">  </a></li><li class="scaffold-layout__list-item">x</li>'
    pages = spark.createDataFrame([(1, f"<ul>{card}{blank}</ul>"), (2, "")], "page_id int, html string")
    rows = html.job_fields(html.job_cards(pages)).orderBy("card_index").collect()
    assert [(r.title, r.company, r.location, r.link) for r in rows] == [("SDE", "Acme", "Pune", "https://www.linkedin.com/jobs/view/5/"), ("(unknown title)", "(unknown company)", "", "https://www.linkedin.com/jobs/view/6/")]


@pytest.mark.parametrize(("page", "empty"), [("<p>no RESULTS found</p>", True), ('<div class="search-no-results">x</div>', True), ("<script>No results found</script>", False), ("", False)])
def test_empty_states_and_buttons(spark, page, empty):
    df = spark.createDataFrame([(page + "<button>…see more</button>",)], "html string").select(nodes_of(F.col("html")).alias("n"))
    r = df.select(html.is_empty_state(F.col("n")).alias("e"), html.more_buttons(F.col("n")).alias("b")).first()
    assert r["e"] is empty and r["b"] == ["…see more"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id int, html string, `a.b` string")
    assert html.post_fields(html.post_cards(df), F.lit(AS_OF)).count() == 0 and html.job_fields(html.job_cards(df)).count() == 0


CUT = '<html><body><nav><a href="/a?x=1&copy=2">a</a><a href="/b">b</a></nav><article><h1>Fish &amp;&amp; and&amp</h1><p>1 &lt; 2 &am</p><p>&quot;x&#39;&#x27; &ampx &notin &gt</p></article></body></html>'


def _twin(spark, tmp_path, name):
    from siftwell.plans import registry

    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, CUT), (2, CUT.replace("and&amp", "&amp;lt; &lt")), (3, CUT.replace("&", "&amp;"))], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in got.orderBy("page_id").collect()] == want
    return want


def test_references_end_with_a_semicolon(spark, tmp_path):
    assert decoded("&amp;&amp &copy=2 &#65; &#65 &#x41;&nosuch; &notit; &middot;") == "&&amp &copy=2 A &#65 A&nosuch; &notit; ·"
    assert read_nodes('<a href="/a?x=1&copy=2&amp;y">')[0]["attrs"] == {"href": "/a?x=1&copy=2&y"}
    assert [r[3] for r in _twin(spark, tmp_path, "page_outline")] == ["Fish && and&amp", "Fish && &lt; &lt", "Fish &amp;&amp; and&amp"]


def test_cut_references_in_the_text_of_posts(spark, tmp_path):
    texts = [r[4] for r in _twin(spark, tmp_path, "post_cards_of_pages")]
    assert texts[0] == "Fish && and&amp 1 < 2 &am \"x'' &ampx &notin &gt"


def test_trees_are_handed_over_in_slices(spark):
    from siftwell.sources.tree import _arrays

    pages = [FULL, None, ACTIVITY, "", *(f'<p class="a" id=x{k}>x<br>{k}</p>' for k in range(500)), RESHARE]
    want = [read_nodes(p) for p in pages]
    for most in (1, 50, 10**9):
        parts = list(_arrays(pages, most))
        assert [t for a in parts for t in a.to_pylist(maps_as_pydicts="strict")] == want
        assert all(len(a.flatten()) - len(a[-1]) < most for a in parts)
    assert len(list(_arrays(pages, 50))) > 20 and list(_arrays([], 50)) == []
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string").coalesce(1)
    for most in (1, 50):
        got = [r["n"] for r in df.select("k", nodes_of(F.col("html"), most).alias("n")).orderBy("k").collect()]
        assert [[n.asDict() for n in tree] for tree in got] == want


def _reads_in_slices(spark, tmp_path, name, capsys):
    from pyspark.util import PythonEvalType

    from siftwell.plans import registry

    spark.createDataFrame([(1, CUT)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    registry.queries()[name](spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    return f"], {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan and f"], {PythonEvalType.SQL_ARROW_BATCHED_UDF}" not in plan


def test_listings_are_read_in_slices(spark, tmp_path, capsys):
    assert _reads_in_slices(spark, tmp_path, "job_cards_of_pages", capsys)


def test_names_are_read_in_slices(spark, tmp_path, capsys):
    assert _reads_in_slices(spark, tmp_path, "frequent_names_of_pages", capsys)


def test_names_of_all_scopes_come_from_one_reading(spark, tmp_path, capsys):
    from siftwell.plans import registry

    spark.createDataFrame([(1, CUT)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    registry.queries()["frequent_names_of_pages"](spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == plan.count("+- ArrowEvalPython") == 1 and "WindowGroupLimit" in plan


def test_each_scope_keeps_its_own_number_of_names(spark):
    from siftwell.sources.report import most_frequent

    rows = [(scope, f"n{k:02d}", 9 - k // 20) for scope in ("class", "carrier_class", "other") for k in range(60)] + [("carrier_attribute", "x", 1)]
    got = [tuple(r) for r in most_frequent(spark.createDataFrame(rows, "scope string, name string, n long")).collect()]
    want = [r for r in rows if r[0] == "class"][:40] + [r for r in rows if r[0] == "carrier_class"][:25] + rows[-1:]
    assert sorted(got) == sorted(want)


def test_posts_cut_anywhere_in_a_reference_equal_their_sql(spark, tmp_path):
    from siftwell.plans import registry

    duckdb = pytest.importorskip("duckdb")
    cuts = [f"&{name[:k]}" for name in ("amp", "quot", "lt", "gt", "copy", "#39", "#x27") for k in range(len(name) + 1)]
    pages = [(k, f"<article><h1>Fish {cut}</h1><p><b>more {cut}<br><p>and &amp;{cut[1:]};chips {cut}</p></article>") for k, cut in enumerate(cuts)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, post_text FROM ({registry.oracle_sql()['post_cards_of_pages']}) ORDER BY page_id").fetchall()
    got = registry.queries()["post_cards_of_pages"](spark, str(tmp_path)).select("page_id", "post_text").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == want and want[3][1] == "Fish &amp more &amp and &amp;chips &amp"
