"""Queries over ``pages``: hosts, links, fields of stored HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.urls import classify_links, clean_link, host, host_in, hrefs, link_categories, normalised_href, resolve_links
from siftwell.plans.registry import query, table
from siftwell.sources.html import attribute, job_cards, job_fields, post_cards, post_fields, says_no_results
from siftwell.sources.report import most_frequent, name_counts, page_facts
from siftwell.sources.tree import Rule, all_of, below, first_of_rule, nodes_of, text_content

_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
_ORGS = ("example.org",)


@query(r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean FROM pages")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", clean_link(F.col("url")).alias("clean"))


@query(f"SELECT page_id, {_HOST} AS host, regexp_matches({_HOST}, '(^|\\.)example\\.org$') AS is_org FROM pages")
def host_suffix_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), host_in(h, _ORGS).alias("is_org"))


_LINKS = rf"WITH p AS (SELECT page_id, regexp_replace(url, '[).,;]+$', '') AS u, {_HOST} AS h, regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?i)/(careers?|jobs?|job-openings?|openings?|internships?|join-us|joinus)(/|$)') AS careers, contains(replace({_HOST}, '-', ''), 'ththre') AS own FROM pages)"


@query(f"{_LINKS} SELECT page_id, CASE WHEN careers OR own THEN 'careers' ELSE 'unknown' END AS kind, 1 AS n_urls FROM p")
def page_link_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = classify_links(F.array("url"), F.lit("Ththre Labs"))
    return table(spark, sf_dir, "pages").withColumn("v", v).select("page_id", F.col("v.kind").alias("kind"), F.size("v.urls").alias("n_urls"))


@query(f"{_LINKS} SELECT page_id, CASE WHEN own THEN 'company_domain' WHEN careers THEN 'ats_or_careers' ELSE 'unknown' END AS categories FROM p")
def page_link_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = F.lit("Ththre Labs")
    pages = table(spark, sf_dir, "pages").withColumn("v", classify_links(F.array("url"), company))
    return pages.select("page_id", F.array_join(link_categories(F.col("v"), company), ",").alias("categories"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS href FROM pages""")
def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(hrefs(F.col("html"))).alias("href"))


@query("""SELECT page_id, count(*) AS n, count(DISTINCT regexp_replace(h, '[).,;]+$', '')) AS n_distinct FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS h FROM pages) GROUP BY page_id""")
def href_absolute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.filter(F.transform(hrefs(F.col("html")), normalised_href), lambda u: u != "")
    return table(spark, sf_dir, "pages").select("page_id", links.alias("u")).where(F.size("u") > 0).select("page_id", F.size("u").cast("long").alias("n"), F.size(F.array_distinct("u")).cast("long").alias("n_distinct"))


@query("""SELECT page_id, regexp_extract(html, '(?i)\\blang="([^"]*)"', 1) AS lang, contains(lower(html), 'no results found') OR contains(lower(html), 'no matching jobs found') AS is_empty FROM pages""")
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", attribute(F.col("html"), "lang").alias("lang"), says_no_results(F.col("html")).alias("is_empty"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://jobs.lever.co/x/' || page_id ELSE 'https://lnkd.in/p' || page_id END AS final FROM pages")
def redirect_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.array(F.concat(F.lit("https://lnkd.in/p"), F.col("page_id").cast("string"))).alias("urls"))
    known = pages.where("page_id % 4 = 0").select(F.element_at("urls", 1).alias("url"), F.concat(F.lit("https://jobs.lever.co/x/"), F.col("page_id").cast("string")).alias("final_url"))
    out = resolve_links(pages, "page_id", "urls", known)
    return out.select("page_id", F.coalesce(F.try_element_at("resolved", F.element_at("urls", 1)), F.element_at("urls", 1)).alias("final"))




def _plain(sql: str) -> str:
    """SQL that decodes the entities of the pages."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return sql


_SHOWN = r"regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'gs')"


@query(
    rf"""SELECT page_id, len(regexp_extract_all({_SHOWN}, '<[a-zA-Z]')) + len(regexp_extract_all(html, '<(script|style)[ >]')) AS n_elements,
    len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a ')) AS n_nav_links, {_plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
    length({_plain("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', '', 'g')")}) AS article_chars FROM pages"""
)
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    pages = table(spark, sf_dir, "pages").select("page_id", nodes_of(F.col("html")).alias("n"))
    return pages.select(
        "page_id",
        F.size(F.filter(n, lambda x: ~x["tag"].startswith("#"))).cast("long").alias("n_elements"),
        F.size(all_of(n, Rule(("a",), within=Rule(("nav",))))).cast("long").alias("n_nav_links"),
        text_content(below(n, first_of_rule(n, Rule(("h1",))))).alias("heading"),
        F.char_length(text_content(below(n, first_of_rule(n, Rule(("article",)))))).cast("long").alias("article_chars"),
    )


_CARD = (
    '<main><ul><li role="listitem" componentkey="FLAGSHIP_SEARCH-', '"><div><a href="/in/user', '/?x=1"><span>Photo</span></a><button aria-label="Open control menu for post by User ', ' 2nd">..</button><span>Engineer at Acme, 1,200 followers</span><p><a href="/feed/update/urn%3Ali%3Aactivity%3A740000000000',
    '/?r=1">', 'd</a> <svg aria-label="Visibility: Global"></svg></p></div><div data-testid="expandable-text-box">', '</div><a href="/jobs/view/', '/?x=2">Job</a><span>7 comments</span></li></ul></main>',
)


@query(
    rf"""WITH cut AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art FROM pages),
    lined AS (SELECT page_id, {_plain("regexp_replace(art, '<[^>]*>', '', 'g')")} AS flat, list_filter(list_transform(string_split({_plain("regexp_replace(regexp_replace(art, '<(br|/?(p|h1|div|ul|li|article|nav|footer))( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')")}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM cut),
    texts AS (SELECT page_id, trim(array_to_string(list_filter(lines, lambda x, i: list_position(lines, x) = i), ' '), ' ·-–—') AS shown, trim(regexp_replace(flat, '\s+', ' ', 'g'), ' ·-–—') AS flat FROM lined)
    SELECT page_id, 'User ' || page_id AS poster, 'Acme' AS company, 'Photo .. Engineer at Acme, 1,200 followers ' || (page_id % 6 + 1) || 'd' AS poster_headline,
    CASE WHEN length(flat) > length(shown) THEN flat ELSE shown END AS post_text, (page_id % 6 + 1)::DOUBLE AS days_old, (page_id % 6 + 1) || 'd ago' AS post_date,
    'https://www.linkedin.com/feed/update/urn:li:activity:740000000000' || lpad((page_id % 10000000)::VARCHAR, 7, '0') || '/' AS post_url, 'https://www.linkedin.com/jobs/view/' || page_id || '/' AS job_link,
    1200 AS follower_count, 7 AS comments, 'company:poster-headline,post_url:exact' AS reasons FROM texts"""
)
def post_cards_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    article = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    parts = [number, number, number, F.lpad((F.col("page_id") % 10_000_000).cast("string"), 7, "0"), (F.col("page_id") % 6 + 1).cast("string"), article, number]
    markup = F.concat(F.lit(_CARD[0]), *(c for part, text in zip(parts, _CARD[1:], strict=True) for c in (part, F.lit(text))))
    cards = post_cards(table(spark, sf_dir, "pages").select("page_id", markup.alias("html")))
    return post_fields(cards, F.lit("2024-01-31 00:00:00")).select(
        "page_id", "poster", "company", "poster_headline", "post_text", "days_old", "post_date", "post_url", "job_link", "follower_count", F.col("engagement")["comments"].alias("comments"), F.array_join("reasons", ",").alias("reasons")
    )


@query(
    r"""SELECT page_id, (i - 1)::INT AS card_index, hrefs[i] AS title, 'Org ' || page_id AS company, 'https://www.linkedin.com/jobs/view/' || page_id || i || '/' AS link
    FROM (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS hrefs FROM pages), unnest(range(1, len(hrefs) + 1)) t(i)"""
)
def job_cards_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda h, i: F.concat(F.lit('<li data-occludable-job-id="1"><a class="x job-card-list__title" href="/jobs/view/'), F.col("page_id"), i + 1, F.lit('/?t=1"><b>'), h, F.lit('</b></a><div class="artdeco-entity-lockup__subtitle">Org '), F.col("page_id"), F.lit("</div>"))
    found = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<ul>"), F.array_join(F.transform(found, item), ""), F.lit("</ul>")).alias("html"))
    return job_fields(job_cards(pages)).select("page_id", "card_index", "title", "company", "link")


_MARKED = """SELECT page_id, regexp_replace(regexp_replace(replace(replace(html, 'class="ad"', 'class="ad-post update"'), '<article', '<article data-id="x-share-' || page_id || '" class="feed-' || coalesce(regexp_extract(html, '<title>([A-Za-z]+)', 1), '') || ' big"'), '<!--.*?-->', '', 'gs'), '(<(?:script|style)[^>]*>).*?</(?:script|style)>', '\\1', 'gs') AS h FROM pages"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose article carries a post's name and a class from its title, and whose advertisements look like posts."""
    word = F.regexp_extract("html", "<title>([A-Za-z]+)", 1)
    article = F.concat(F.lit('<article data-id="x-share-'), F.col("page_id").cast("string"), F.lit('" class="feed-'), word, F.lit(' big"'))
    html = F.replace(F.replace("html", F.lit('class="ad"'), F.lit('class="ad-post update"')), F.lit("<article"), article)
    return table(spark, sf_dir, "pages").select("page_id", html.alias("html"))


@query(f"""SELECT page_id, len(regexp_extract_all(h, '<[a-zA-Z][^>]*>')) AS n_elements, len(regexp_extract_all(h, '<article[^>]*>')) AS n_carriers FROM ({_MARKED})""")
def element_counts_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts(_marked(spark, sf_dir)).select("page_id", "n_elements", "n_carriers")


@query(
    f"""WITH t AS (SELECT unnest(regexp_extract_all(h, '<[a-zA-Z][^>]*>')) AS tag FROM ({_MARKED})),
    c AS (SELECT contains(tag, 'data-id=') AS carrier, unnest(string_split(regexp_extract(tag, ' class="([^"]*)"', 1), ' ')) AS name FROM t),
    a AS (SELECT unnest(regexp_extract_all(tag, ' ([a-z-]+)=', 1)) AS name FROM t WHERE contains(tag, 'data-id=')),
    n AS (SELECT 'carrier_class' AS scope, name FROM c WHERE carrier AND name <> '' UNION ALL SELECT 'carrier_attribute', name FROM a UNION ALL SELECT 'class', name FROM c WHERE regexp_matches(name, '(?i)feed|update|post|search-result|occludable|entity|actor|commentary|scaffold')),
    g AS (SELECT scope, name, count(*) AS n FROM n GROUP BY scope, name), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, name) AS k FROM g)
    SELECT scope, name, n FROM r WHERE k <= CASE WHEN scope = 'class' THEN 40 ELSE 25 END"""
)
def frequent_names_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent classes and attributes of cards and feeds: a report of the first 25 or 40."""
    return most_frequent(name_counts(_marked(spark, sf_dir)))
