"""Whole flows and match rules over every row of ``events`` and ``pages``.

An event becomes a post: its id numbers it and picks one of a few texts, its user is the
poster and picks the company.  The SQL twins name the outcome from the same columns, and
compute what depends on other rows: first occurrences, limits, batches and blocked posters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.dates import age_days
from siftwell.functions.text import clean_name, without_doubling
from siftwell.functions.urls import classify_links
from siftwell.operators.matching import candidate_net, funding_mentions, strong_match
from siftwell.operators.provenance import first_party
from siftwell.operators.walks import company_walk, fill_permalinks, gate_batches, history_rows, keyword_posts, relevance_gate, semantic_gate
from siftwell.plans.registry import query, table
from siftwell.schemas import HISTORY, POST, conform

SITE = "https://www.linkedin.com"
AS_OF = "2024-01-31 00:00:00"
COMPANIES = ("Acme", "Zeta", "Orion", "Nimbus", "Quartz")
_C = "(['" + "', '".join(COMPANIES) + "'])[user_id % 5 + 1]"
_DAYS = "greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400e6)"
_NO_LINKS = "cast(array() as array<string>)"


def _pick(values: Sequence[str], by: Column) -> Column:
    """The value at ``by``, in which ``{}`` stands for the row's company."""
    texts = F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return F.replace(texts, F.lit("{}"), F.col("company"))


def _case(values: Sequence[object], by: str = "event_id") -> str:
    """The same choice in SQL."""
    shown = [str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in values]
    whens = " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(shown))
    chosen = f"CASE {by} % {len(values)} {whens} END"
    return chosen if isinstance(values[0], bool) else f"replace({chosen}, '{{}}', {_C})"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = F.element_at(F.array(*map(F.lit, COMPANIES)), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").withColumn("company", company)


def _posts(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    """Events as posts of their user, with the given columns; other columns of a post are blank."""
    rows = _events(spark, sf_dir)
    made = {"seq": F.col("event_id"), "poster": F.concat(F.lit("User "), F.col("user_id").cast("string")), "outbound_links": F.expr(_NO_LINKS), "link_categories": F.expr(_NO_LINKS), "days_old": age_days(F.col("ts"), F.to_timestamp(F.lit(AS_OF)))}
    rows = rows.withColumns(made | columns)
    return rows.withColumns({f.name: F.lit("").cast(f.dataType) if f.dataType.simpleString() == "string" else F.lit(None).cast(f.dataType) for f in POST if f.name not in rows.columns})


_STRONG = (
    ("We're hiring an AI intern at {} to work on ML fraud models. Apply now.", True, "company:{}; hiring:we're hiring; role:intern; domain:ai; proximity:hire+intern≤15w; offer:we're hiring~intern~ai"),
    ("Last year as an intern I learned a lot about AI at {}. We're hiring.", False, "company:{}; hiring:hiring, we're hiring; role:intern; domain:ai; proximity:intern only in narrative/program phrasing"),
    ("We're hiring an AI intern. Apply now.", False, "company:none; hiring:we're hiring; role:intern; domain:ai; proximity:hire+intern≤15w; offer:we're hiring~intern~ai"),
    ("{} internship module for ML. Looking for learners.", False, "company:{}; hiring:looking for; role:internship; domain:ml; proximity:intern only in narrative/program phrasing"),
    ("  ", False, "company:none; hiring:none; role:none; domain:none; proximity:none"),
)


@query(f"SELECT event_id, {_case([r[1] for r in _STRONG])} AS matched, {_case([r[2] for r in _STRONG])} AS why FROM events")
def strong_matches_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("post_text", _pick([r[0] for r in _STRONG], F.col("event_id")))
    return strong_match(rows, F.col("company"), F.col("post_text")).select("event_id", "matched", F.array_join("reasons", "; ").alias("why"))


_NET = (
    ("{} has an internship.", True, "company:{}; hiring:none; role:internship"),
    ("I completed my internship at {}!", False, "company:{}; candidate_terms:internship; celebration:obvious"),
    ("An internship somewhere.", False, "company:none; hiring:none; role:internship"),
)


@query(f"SELECT event_id, {_case([r[1] for r in _NET])} AS matched, {_case([r[2] for r in _NET])} AS why FROM events")
def candidate_net_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("post_text", _pick([r[0] for r in _NET], F.col("event_id")))
    return candidate_net(rows, F.col("company"), F.col("post_text")).select("event_id", "matched", F.array_join("reasons", "; ").alias("why"))


_FIRST = (
    ("Asha", "SWE @ {}", "{} is hiring a software engineering intern. Comment for referral.", "employee", True, "real opening (target named as hiring org; role+apply path)"),
    ("Jobs Daily", "", "{} is hiring interns. Apply now.", "aggregator", False, "aggregator account (Jobs Daily)"),
    ("Sam", "31k+ LinkedIn", "{} is hiring an AI intern https://careers.x.example/x", "creator", True, "real opening (target named as hiring org; role+apply path)"),
    ("Sam", "Writer", "{} is hiring. 3+ years of experience needed.", "creator", False, "experienced role, not an internship opening"),
    ("Sam", "Writer", "I like {}.", "creator", False, "off-topic: target mentioned but not as the hiring org"),
    ("Sam", "Writer", "{} is hiring people.", "creator", False, "no concrete opening (missing specific role + apply path)"),
    ("{}", "", "Role: data intern in Pune", "company", False, "no concrete opening (missing apply path)"),
    ("{}", "Verified", "Role: data intern in Pune", "company", True, "borderline opening rescued by poster credibility (verified)"),
    ("", "", "Join my community", "spam", False, "community / paid-service spam, no real role"),
)


@query(f"SELECT event_id, {_case([r[3] for r in _FIRST])} AS source_type, {_case([r[4] for r in _FIRST])} AS keep, {_case([r[5] for r in _FIRST])} AS why FROM events")
def first_party_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    poster, headline, text = (_pick([r[n] for r in _FIRST], F.col("event_id")) for n in range(3))
    made = first_party(_events(spark, sf_dir), F.col("company"), poster, headline, text, F.expr(_NO_LINKS))
    return made.select("event_id", "source_type", "keep", F.col("keep_reason").alias("why"))


_HIRE = "{} is hiring an AI intern. We're hiring now, apply here."
_WALK = (_HIRE, "I admire {} a lot.", "Nothing here", _HIRE + " 3+ years of experience needed.")


@query(
    f"WITH e AS (SELECT event_id AS seq, {_C} AS target, event_id % 4 AS kind, {_DAYS} AS days, min(event_id) OVER (PARTITION BY user_id, event_id % 4) AS first FROM events), "
    "s AS (SELECT seq, target, CASE WHEN days > 30 THEN 'too_old' WHEN kind = 1 THEN 'prefilter' WHEN kind = 3 THEN 'source' ELSE 'kept' END AS stage FROM e WHERE seq = first AND kind <> 2), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY target, stage ORDER BY seq) AS n FROM s) "
    "SELECT seq, target, CASE WHEN stage = 'kept' AND n > 20 THEN 'over_limit' ELSE stage END AS stage FROM n"
)
def company_walk_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post that names one of five companies, once a poster and text, and the stage it ended in."""
    posts = _posts(spark, sf_dir, post_text=_pick(_WALK, F.col("event_id")), company=F.lit(""), outbound_links=F.array(F.lit("https://boards.greenhouse.io/x/jobs/1")))
    targets = spark.createDataFrame([(c,) for c in COMPANIES], "target string")
    return company_walk(posts, targets, limit=20).select("seq", "target", "stage")


_KEYWORD = ("We're hiring an AI intern to work on LLM evaluation. Apply now.", "We're hiring an AI intern. Apply now.\nJoin my telegram group", "I like tea.")


@query(
    f"WITH e AS (SELECT event_id AS seq, user_id, event_id % 3 AS kind, {_DAYS} AS days, min(event_id) OVER (PARTITION BY user_id, event_id % 3) AS first FROM events) "
    "SELECT seq, CASE WHEN user_id % 7 = 0 THEN 'undated' WHEN days > 21 THEN 'too_old' WHEN kind = 2 THEN 'not_hiring' WHEN kind = 1 THEN 'source' ELSE 'kept' END AS stage FROM e WHERE seq = first"
)
def keyword_posts_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword flow, with rows that end in every stage."""
    days = F.when(F.col("user_id") % 7 != 0, age_days(F.col("ts"), F.to_timestamp(F.lit(AS_OF))))
    posts = _posts(spark, sf_dir, post_text=_pick(_KEYWORD, F.col("event_id")), days_old=days, company=F.lit(""))
    return keyword_posts(posts, max_age=21).select("seq", "stage")


_FLAGS = ("author_is_hirer", "is_offer_not_request", "cta_is_application", "role_named")
_GATED = ("Apply here", "I'm looking for a role", "text")


@query(
    f"WITH b AS (SELECT user_id, count(*) FILTER (event_type = 'error') >= 2 AS blocked FROM events GROUP BY user_id), "
    f"e AS (SELECT event_id AS seq, user_id, {_C} AS company, event_id % 3 AS kind, event_id % 5 = 4 AS unjudged, event_type FROM events), "
    "s AS (SELECT *, CASE WHEN kind = 1 THEN 'gate:candidate_seeking' WHEN blocked THEN 'gate:blocked_profile' WHEN unjudged THEN 'gate:invalid_json' WHEN kind = 0 THEN 'kept' ELSE 'gate:not_hirer' END AS stage FROM e JOIN b USING (user_id)), "
    "j AS (SELECT *, stage IN ('kept', 'gate:not_hirer') AS judged FROM s) "
    "SELECT seq, stage, company, 'User ' || user_id AS poster, stage = 'kept' AS kept, CASE WHEN judged THEN 'company_hiring' ELSE 'other' END AS intent, "
    "CASE WHEN judged THEN event_type ELSE '' END AS gate_reason, judged AS role_named, false AS author_is_hirer FROM j"
)
def semantic_gate_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts screened, batched, judged by a table of verdicts and turned into history rows."""
    posts = _posts(spark, sf_dir, post_text=_pick(_GATED, F.col("event_id")), post_url=F.concat(F.lit("u"), F.col("event_id").cast("string"))).withColumns({"poster_employer": F.lit(""), "author_affiliation_matches_target": F.lit(False)})
    history = conform(posts.where("event_type = 'error'").select("company", "poster", F.lit(False).alias("kept")), HISTORY)
    flags = {k: F.lit(k in ("role_named", "is_offer_not_request")) for k in _FLAGS}
    verdicts = gate_batches(posts, history).where("seq % 5 <> 4").select("company", "batch", "id", F.col("event_type").alias("reason")).withColumns(flags | {"intent": F.lit("company_hiring")})
    gated = semantic_gate(posts, verdicts, history)
    rows = history_rows(gated, "2024-01-31T00:00:00").withColumn("seq", F.substring("post_url", 2, 20).cast("long"))
    facts = rows.select("seq", "company", "poster", "kept", "intent", "gate_reason", "role_named", "author_is_hirer")
    return gated.select("seq", "stage").join(facts, "seq")


@query(
    "WITH e AS (SELECT event_id AS seq, user_id, event_type, (['creator', 'company', 'aggregator', 'recruiter'])[event_id % 4 + 1] AS kind FROM events WHERE event_id % 3 <> 0) "
    "SELECT seq, CASE kind WHEN 'company' THEN 0 WHEN 'recruiter' THEN 2 ELSE 3 END::INT AS rank, kind AS source_type, 'gate:keep,source:' || kind || '; poster:User ' || user_id || '; followers:' || (user_id % 50 + 1) || 'k (' || event_type || ')' AS why FROM e WHERE kind <> 'aggregator'"
)
def relevance_gate_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    headline = F.concat((F.col("user_id") % 50 + 1).cast("string"), F.lit("k followers"))
    posts = _posts(spark, sf_dir, post_text=F.lit("t"), poster_headline=headline)
    verdicts = posts.select("seq", (F.col("event_id") % 3 != 0).alias("keep"), F.col("event_type").alias("reason"), _pick(("creator", "company", "aggregator", "recruiter"), F.col("event_id")).alias("source_type"))
    return relevance_gate(posts, verdicts).select("seq", "rank", "source_type", F.col("why_matched").alias("why"))


@query("SELECT event_id, 'pre-seed|backed by Sequoia and Accel|raised $' || (user_id + 1) || ' million|Series ' || (['A', 'B', 'C'])[event_id % 3 + 1] AS phrases FROM events")
def funding_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("A pre-seed stage startup, backed by Sequoia and Accel. We raised $"), (F.col("user_id") + 1).cast("string"), F.lit(" million last year, now "), _pick(("Series A", "Series B", "Series C"), F.col("event_id")), F.lit(", no longer pre-seed."))
    return _events(spark, sf_dir).select("event_id", F.array_join(funding_mentions(said), "|").alias("phrases"))


@query("SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN c_mktsegment || ' 3rd+ • 2d • Edited' ELSE c_mktsegment END AS line, c_mktsegment AS name FROM customer")
def names_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("c_mktsegment")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(own, F.lit(" 3rd+ • 2d • Edited"))).otherwise(F.concat(own, F.lit("\n"), own))
    return table(spark, sf_dir, "customer").select("c_custkey", without_doubling(raw).alias("line"), clean_name(raw).alias("name"))


_ID = "(7400000000000000000 + page_id)"


@query(
    f"SELECT page_id AS seq, (['exact', 'anchor', 'cache', 'no_permalink'])[page_id % 4 + 1] AS url_reason, CASE page_id % 4 WHEN 2 THEN 'https://cached.example/' || page_id WHEN 3 THEN '' ELSE '{SITE}/feed/update/urn:li:activity:' || {_ID} || '/' END AS post_url FROM pages"
)
def permalink_fill_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are exact, stand in an anchor, are remembered by poster and text, or can't be had."""
    page, kind = F.col("page_id"), F.col("page_id") % 4
    digits = (F.lit(7400000000000000000).cast("long") + page).cast("string")
    posts = table(spark, sf_dir, "pages").select(
        page.alias("seq"),
        F.concat(F.lit("P"), page.cast("string")).alias("poster"),
        F.lit("Hello").alias("post_text"),
        F.lit("").alias("activity_urn"),
        F.when(kind == 0, F.concat(F.lit(f"{SITE}/feed/update/urn:li:activity:"), digits, F.lit("/"))).when(kind == 3, f"{SITE}/search/results/content/").otherwise("").alias("post_url"),
        F.when(kind == 1, F.array(F.lit("/in/b/"), F.concat(F.lit("/feed/update/urn%3Ali%3Aactivity%3A"), digits, F.lit("/")))).otherwise(F.expr(_NO_LINKS)).alias("outbound_links"),
    )
    cache = posts.where("seq % 4 = 2").select(F.concat(F.lower("poster"), F.lit("|hello")).alias("cache_key"), F.concat(F.lit("https://cached.example/"), F.col("seq").cast("string")).alias("permalink"))
    return fill_permalinks(posts, cache).select("seq", "url_reason", "post_url")


@query(
    "SELECT page_id, (['careers', 'junk', 'none', 'unknown'])[page_id % 4 + 1] AS kind, ([2, 2, 0, 1])[page_id % 4 + 1]::INT AS n, CASE page_id % 4 WHEN 0 THEN 'link:junk:chat.whatsapp.com; link:careers:boards.greenhouse.io' "
    "WHEN 1 THEN 'link:junk:chat.whatsapp.com; link:unknown:x' || page_id || '.example' WHEN 2 THEN '' ELSE 'link:unknown:x' || page_id || '.example' END AS reasons FROM pages"
)
def link_sets_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of links judged together: an application link outweighs a group invitation."""
    page, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    own = F.concat(F.lit("https://x"), page, F.lit(".example/1"))
    chat, ats = F.lit("https://chat.whatsapp.com/a"), F.concat(F.lit("https://boards.greenhouse.io/"), page)
    urls = F.when(kind == 0, F.array(chat, ats)).when(kind == 1, F.array(chat, own)).when(kind == 2, F.array(F.lit("/in/someone"), F.lit("#top"))).otherwise(F.array(F.concat(F.upper(F.lit("https://x")), page, F.lit(".example/1/")), own))
    made = table(spark, sf_dir, "pages").withColumn("v", classify_links(urls, F.lit("Acme")))
    return made.select("page_id", F.col("v.kind").alias("kind"), F.size("v.urls").alias("n"), F.array_join("v.reasons", "; ").alias("reasons"))
