"""Rules of links, queries, labels and result rows over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import engagement, is_more_label, is_truncated, snippet
from siftwell.functions.urls import company_host, host, is_internal, is_outbound, is_shortener, job_id, job_link, unwrapped
from siftwell.operators.classes import merged, pending, read_replies
from siftwell.operators.provenance import engagement_signal
from siftwell.operators.search_terms import is_prose, sanitised
from siftwell.operators.verdicts import post_block
from siftwell.operators.walks import assign_strays, is_startup, label_companies
from siftwell.plans.registry import query, table
from siftwell.sinks.writers import result_blocks, result_row


@query(
    r"""SELECT conv_id, turn, t <> '' AND (contains(t, chr(10)) OR length(t) > 160 OR len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) > 22
    OR (length(t) - length(replace(t, '.', '')) >= 2 AND length(t) > 80)) AS prose FROM (SELECT conv_id, turn, trim(coalesce(text, '')) AS t FROM conversations)"""
)
def prose_queries_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns, taken as search queries, are pasted text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", is_prose(F.coalesce("text", F.lit(""))).alias("prose"))


@query(
    """WITH q AS (SELECT s_suppkey, trim(s_name) AS name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
    SELECT s_suppkey, '"' || name || '" intern; ' || n_name || ' jobs' AS queries FROM q"""
)
def sanitised_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's queries for every supplier: the name is filled in, repeats and pasted text go."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    asked = F.array(F.lit('"{company}" intern'), F.lit(" "), F.upper(F.concat(F.lit('"'), "s_name", F.lit('" INTERN'))), F.concat("n_name", F.lit(" jobs")), F.rpad(F.lit("We are hiring. "), 200, "Join us. "))
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select("s_suppkey", F.array_join(sanitised(asked, F.trim("s_name")), "; ").alias("queries"))


_URLS = """SELECT page_id, i, CASE WHEN i = 1 THEN url WHEN i = 2 THEN 'https://lnkd.in/' || substr(h, 1, 3) WHEN i = 3 THEN 'https://www.linkedin.com/in/' || h
    WHEN i = 4 THEN 'https://www.linkedin.com/jobs/view/' || page_id || '/?x=' || length(h) ELSE '/safety/go/?url=https%3A%2F%2Fx.example%2F' || page_id END AS raw
    FROM (SELECT page_id, url, coalesce(regexp_extract(html, '<a href="/([a-z]+)"', 1), '') AS h FROM pages), unnest(range(1, 6)) t(i)"""


def _urls(pages: DataFrame) -> DataFrame:
    """Five links of a page, made from its address, its first plain anchor and its number."""
    h, number = F.col("h"), F.col("page_id").cast("string")
    links = F.array(
        "url", F.concat(F.lit("https://lnkd.in/"), F.substring(h, 1, 3)), F.concat(F.lit("https://www.linkedin.com/in/"), h),
        F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number, F.lit("/?x="), F.char_length(h).cast("string")), F.concat(F.lit("/safety/go/?url=https%3A%2F%2Fx.example%2F"), number),
    )
    return pages.withColumn("h", F.coalesce(F.regexp_extract("html", '<a href="/([a-z]+)"', 1), F.lit(""))).select("page_id", links.alias("links"))


@query(
    f"""WITH u AS ({_URLS}) SELECT page_id, i::INT AS i, CASE WHEN i = 5 THEN 'https://x.example/' || page_id ELSE raw END AS target, i = 2 AS shortener, i IN (3, 4) AS internal, i IN (1, 2, 4) AND raw LIKE 'http%' AS outbound,
    i = 1 AND contains(replace(lower(regexp_extract(raw, '^[a-z]+://([^/?#:]*)', 1)), '-', ''), 'ththre') AS own, CASE WHEN i = 4 THEN page_id::VARCHAR ELSE raw END AS job FROM u"""
)
def link_predicates_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _urls(table(spark, sf_dir, "pages")).select("page_id", F.posexplode("links").alias("k", "raw"))
    u = F.col("raw")
    return rows.select("page_id", (F.col("k") + 1).alias("i"), unwrapped(u).alias("target"), is_shortener(u).alias("shortener"), is_internal(u).alias("internal"), is_outbound(u).alias("outbound"), company_host(host(u), F.lit("Ththre Labs")).alias("own"), job_id(u).alias("job"))


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.linkedin.com/jobs/view/' || page_id || '/' ELSE 'https://lnkd.in/' || substr(coalesce(regexp_extract(html, '<a href="/([a-z]+)"', 1), ''), 1, 3) END AS link FROM pages"""
)
def job_links_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link to a posting among a page's links; odd pages have no job view."""
    links = F.when(F.col("page_id") % 2 == 0, F.col("links")).otherwise(F.filter("links", lambda u: ~u.contains("/jobs/")))
    return _urls(table(spark, sf_dir, "pages")).select("page_id", job_link(links).alias("link"))


@query(
    r"""SELECT doc_id, regexp_matches(s, '(…|\.\.\.)\s*([mM][oO][rR][eE])?\s*$') AS truncated, regexp_matches(right(s, 9), '(?i)^\s*(…|\.{2,3})?\s*(see\s+)?more\s*$') AS label
    FROM (SELECT doc_id, CASE WHEN length(t) > 240 THEN rtrim(substr(t, 1, 239)) || '…' ELSE t END AS s FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents))"""
)
def cut_texts_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which snippets were cut, and which end like a button that shows more."""
    s = snippet(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", is_truncated(s).alias("truncated"), is_more_label(F.right(s, F.lit(9))).alias("label"))


@query(
    "SELECT e.event_id, coalesce(r_name = 'ASIA', false) AS startup FROM events e LEFT JOIN nation ON n_nationkey = e.user_id % 30 LEFT JOIN region ON r_regionkey = n_regionkey"
)
def startups_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose company, a nation's name, is classed as a funded startup; the poster names it where the company is blank."""
    facts = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    classes = facts.select(F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("name"), F.when(F.col("r_name") == "ASIA", "funded_startup").otherwise("large_company").alias("category"), F.lit(0.9).alias("confidence"))
    named = F.concat(F.lit(" NATION "), (F.col("user_id") % 30).cast("string"))
    posts = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "").otherwise(named).alias("company"), named.alias("poster"))
    return label_companies(posts, classes).select("event_id", is_startup(F.col("company_class")).alias("startup"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events)
    SELECT n AS out_index, '--- ' || n || ' ---' || chr(10) || 'company: ' || CASE WHEN event_type = 'view' THEN 'User ' || user_id ELSE 'Org ' || user_id END || chr(10) || 'role: ' || event_type || ' wanted' || chr(10)
    || 'why_matched: event ' || event_id || CASE WHEN event_type = 'error' THEN '' ELSE '; gate_reason:ok ' || event_type END || chr(10) || 'post_url: ' || CASE WHEN event_type = 'click' THEN chr(10) || 'source_type: company' ELSE '' END AS block FROM e"""
)
def result_blocks_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as result rows, each a text block; the blocks are numbered in slices."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(kind == "view", "").otherwise(F.concat(F.lit("Org "), F.col("user_id").cast("string"))).alias("company"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("poster"),
        F.lit("").alias("role"), F.concat(kind, F.lit("  wanted")).alias("snippet"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("why_matched"),
        F.when(kind == "error", "").otherwise(F.concat(F.lit("ok "), kind)).alias("gate_reason"), F.lit("").alias("post_url"), F.when(kind == "click", "company").otherwise("").alias("source_type"),
    )
    made = result_row(rows).withColumn("seq", F.regexp_extract("why_matched", r"^event (\d+)", 1).cast("long"))
    return result_blocks(made)


@query(
    """SELECT event_id, v AS likes, CASE WHEN event_type = 'click' THEN 3 ELSE 0 END AS comments, CASE WHEN v = 0 AND event_type = 'view' THEN 'zero_engagement_multiple_shorteners' ELSE '' END AS signal
    FROM (SELECT event_id, event_type, event_id % 4 * 1000 AS v FROM events)"""
)
def engagement_signals_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts read from a card's text, and the sign of posts that nobody answers but that hold several shorteners."""
    said = F.concat(F.format_number(F.col("event_id") % 4 * 1000, 0), F.lit(" reactions · "), F.when(F.col("event_type") == "click", "3 comments, 1 comment").otherwise("0 comments"))
    links = F.array(F.lit("https://lnkd.in/a"), F.when(F.col("event_type") == "view", "https://lnkd.in/b").otherwise("https://x.example/"))
    rows = table(spark, sf_dir, "events").select("event_id", links.alias("links"), engagement(said).alias("e"))
    return rows.select("event_id", F.col("e")["likes"].alias("likes"), F.col("e")["comments"].alias("comments"), engagement_signal(F.col("e"), F.col("links")).alias("signal"))


_STRAY = "urn:li:activity:740000000000"


@query(
    f"""WITH p AS (SELECT page_id, i FROM pages, unnest(range(0, 3)) t(i) WHERE page_id % 3 <> 1 OR i < 2)
    SELECT page_id, i::INT AS i, CASE WHEN i > 0 AND page_id % 3 <> 1 THEN 'https://x.example/' || i WHEN page_id % 3 = 0 THEN 'https://www.linkedin.com/feed/update/{_STRAY}' || lpad((page_id % 10000000)::VARCHAR, 7, '0') || '/' ELSE '' END AS post_url,
    page_id % 3 = 0 AND i = 0 AS stray FROM p"""
)
def strays_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one open post and one URN, with two open posts, and with two URNs: only the first kind is filled."""
    own = F.lpad((F.col("page_id") % 10_000_000).cast("string"), 7, "0")
    link = F.concat(F.lit(f'<a href="/feed/update/{_STRAY}'), own, F.lit('/">'))
    pages = table(spark, sf_dir, "pages")
    marked = pages.select("page_id", F.concat("html", link, F.when(F.col("page_id") % 3 == 2, F.replace(link, F.lit("activity"), F.lit("share"))).otherwise(F.lit(""))).alias("html"))
    posts = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.when(F.col("page_id") % 3 == 1, 1).otherwise(2))).alias("i"))
    posts = posts.withColumn("post_url", F.when((F.col("i") > 0) & (F.col("page_id") % 3 != 1), F.concat(F.lit("https://x.example/"), F.col("i").cast("string"))).otherwise(F.lit("")))
    return assign_strays(posts, marked, "page_id").select("page_id", "i", "post_url", "stray")


@query(
    """SELECT lower(c_name) AS name_key, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'funded_startup' ELSE 'unknown' END AS category,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'low' ELSE 'high' END AS confidence, CASE WHEN c_mktsegment = 'BUILDING' THEN 'cache' ELSE 'model-guess' END AS source FROM customer"""
)
def class_cache_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment is cached; the others are asked for in batches, and a segment is never answered, another with a class that doesn't exist."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    columns = [F.lower("c_name").alias("name_key"), F.col("c_name").alias("name"), F.lit("funded_startup").alias("category"), F.lit("high").alias("confidence"), F.lit("cache").alias("source")]
    cache = customers.where("c_mktsegment = 'BUILDING'").select(*columns)
    twice = customers.select(F.col("c_custkey").alias("seq"), F.concat(F.lit(" "), "c_name").alias("name")).unionByName(customers.select((F.col("c_custkey") + 10**9).alias("seq"), F.upper("c_name").alias("name")))
    asked = pending(twice, cache)
    facts = customers.select(F.lower("c_name").alias("name_key"), "c_mktsegment")
    row = F.struct(F.upper("name").alias("company"), F.when(F.col("c_mktsegment") == "AUTOMOBILE", " Funded_Startup").otherwise("farm").alias("category"), F.lit("HIGH").alias("confidence"))
    answered = asked.join(facts, "name_key").where("c_mktsegment <> 'MACHINERY'")
    replies = answered.groupBy("batch").agg(F.to_json(F.struct(F.collect_list(row).alias("results"))).alias("reply"))
    once = merged(cache, read_replies(replies, asked))
    return merged(once, read_replies(replies, asked)).select("name_key", "category", "confidence", "source")


@query(
    r"""SELECT conv_id, turn, '[' || turn || '] target_company=' || CASE WHEN conv_id % 2 = 0 THEN '"O''Neil"' ELSE '''Acme''' END || ' poster=''' || role || ''' headline='''' role='''' link_class=''''' || chr(10) || 'link_categories: [''a'', ''b'']' || chr(10)
    || 'poster_employer: (unknown); author_affiliation_matches_target: False' || chr(10) || 'engagement: {''likes'': ' || turn || '}' || chr(10) || 'engagement_spam_signal: (none)' || chr(10) || 'profile_prior: (none); profile_opening_domains: []' || chr(10)
    || 'links: https://j/' || conv_id || '; https://x/1' || chr(10) || 'text: ' || CASE WHEN length(t) > 600 THEN rtrim(substr(t, 1, 599)) || '…' ELSE t END AS block
    FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations)"""
)
def prompt_blocks_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the blocks that describe records to a model."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, "O'Neil").otherwise("Acme").alias("company"), F.col("role").alias("poster"), F.array(F.lit("a"), F.lit("b")).alias("link_categories"), F.create_map(F.lit("likes"), F.col("turn")).alias("engagement"),
        F.array(F.lit("https://x/1")).alias("outbound_links"), F.concat(F.lit("https://j/"), F.col("conv_id").cast("string")).alias("job_link"), F.col("text").alias("post_text"),
    )
    return rows.select("conv_id", "turn", post_block(rows, "turn").alias("block"))
