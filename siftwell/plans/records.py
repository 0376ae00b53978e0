"""Rules over whole tables: posts, links, dates and verdicts made from the tables' own columns.

The SQL twins compute their answers from the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.dates import post_age, relative_age
from siftwell.functions.entities import affiliated, employer, folded
from siftwell.functions.text import engagement, escape_markdown, follower_count
from siftwell.functions.urls import activity_permalink, canonical_permalink, content_search_url, is_exact_post, is_feed_page, job_search_url, permalink_cache_key, urls_in_text
from siftwell.operators.provenance import heuristic_reject, roundup_signals
from siftwell.operators.verdicts import drop_reason, parse_strict, parse_tolerant, semantic_keep
from siftwell.operators.scans import cut_scan, scan_listings
from siftwell.operators.walks import label_companies, mention_join
from siftwell.plans.registry import query, table
from siftwell.streaming.feedback import history_of, profiles_of

SITE = "https://www.linkedin.com"
_FOLDED = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'm' WHEN 1 THEN 'h' WHEN 2 THEN 'd' WHEN 3 THEN 'w' WHEN 4 THEN 'mo' ELSE 'yr' END AS unit, user_id % 90 + 1 AS n FROM events) "
    "SELECT event_id, CASE unit WHEN 'm' THEN n / 1440.0 WHEN 'h' THEN n / 24.0 WHEN 'd' THEN n WHEN 'w' THEN n * 7 WHEN 'mo' THEN n * 30.44 ELSE n * 365.25 END::DOUBLE AS days FROM e"
)
def relative_ages_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("m", "h", "d", "w", "mo", "yr"))), (F.col("event_id") % 6 + 1).cast("int"))
    said = F.concat(F.lit("posted "), (F.col("user_id") % 90 + 1).cast("string"), F.when(F.col("event_id") % 2 == 0, "").otherwise(" "), unit, F.lit(" ago"))
    return table(spark, sf_dir, "events").select("event_id", relative_age(said).alias("days"))


@query(
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400e6) WHEN 1 THEN (user_id % 20 + 1)::DOUBLE ELSE 7.0 * (user_id % 5 + 1) END AS days FROM events"
)
def post_ages_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp if there is one, else the label, else the description."""
    kind, n = F.col("event_id") % 3, F.col("user_id")
    stamp = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("soon")
    label = F.when(kind == 1, F.concat((n % 20 + 1).cast("string"), F.lit("d"))).otherwise("")
    said = F.concat((n % 5 + 1).cast("string"), F.lit(" weeks ago"))
    return table(spark, sf_dir, "events").select("event_id", post_age(stamp, label, said, F.to_timestamp(F.lit("2024-01-31 00:00:00"))).alias("days"))


@query("SELECT event_id, (event_id % 900 + 1) * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS followers FROM events")
def follower_counts_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 900 + 1).cast("string")
    headline = F.when(F.col("event_id") % 3 == 0, F.concat(n, F.lit(" followers"))).when(F.col("event_id") % 3 == 1, F.concat(n, F.lit("k+ LinkedIn"))).otherwise(F.concat(F.lit("Writer, "), n, F.lit("M followers")))
    return table(spark, sf_dir, "events").select("event_id", follower_count(headline).alias("followers"))


@query("SELECT event_id, greatest(event_id % 1000, user_id % 700) AS likes, (user_id % 50)::BIGINT AS comments, 0::BIGINT AS reposts FROM events")
def engagement_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat_ws(" ", F.col("event_id") % 1000, F.lit("reactions"), F.col("user_id") % 50, F.lit("comments"), F.col("user_id") % 700, F.lit("likes"))
    return table(spark, sf_dir, "events").withColumn("e", engagement(said)).select("event_id", *(F.col("e")[k].alias(k) for k in ("likes", "comments", "reposts")))


_STUDENT = "c_custkey % 5 = 0"


@query(f"SELECT c_custkey, CASE WHEN {_STUDENT} THEN '' ELSE 'Unit' || c_nationkey || ' Labs' END AS employer, NOT ({_STUDENT}) AND c_nationkey = 3 AS affiliated FROM customer")
def employers_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Unit"), F.col("c_nationkey").cast("string"), F.lit(" Labs"))
    headline = F.concat(F.when(F.expr(_STUDENT), "Student at ").otherwise("Engineer at "), name, F.lit(" | "), F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", employer(headline).alias("employer"), affiliated(headline, F.lit("UNIT3 Labs, Inc.")).alias("affiliated"))


_ID = "(7400000000000000000 + page_id)"


@query(
    f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN '{SITE}/feed/update/urn:li:activity:' || {_ID} || '/' WHEN 1 THEN '{SITE}/feed/update/urn:li:ugcPost:' || {_ID} || '/' ELSE '' END AS permalink, "
    f"page_id % 4 < 2 AS exact, page_id % 4 = 3 AS feed, '{SITE}/feed/update/urn:li:activity:' || {_ID} || '/' AS from_digits FROM pages"
)
def permalinks_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = (F.lit(7400000000000000000).cast("long") + F.col("page_id")).cast("string")
    raw = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/feed/update/urn%3Ali%3Aactivity%3A"), digits, F.lit("/?reshareId=1")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit(f"{SITE}/posts/someone-ugcPost-"), digits, F.lit("-abc/?utm=1")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit(f"{SITE}/feed/update/urn:li:activity:"), F.col("page_id").cast("string")))
        .otherwise(F.concat(F.lit(f"{SITE}/in/p"), F.col("page_id").cast("string"), F.lit("/recent-activity/all/")))
    )
    return table(spark, sf_dir, "pages").select("page_id", canonical_permalink(raw).alias("permalink"), is_exact_post(raw).alias("exact"), is_feed_page(raw).alias("feed"), activity_permalink(digits).alias("from_digits"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'urn:li:activity:' || page_id ELSE lower('Poster ' || page_id % 50 || '|' || substr(html, 1, 120)) END AS cache_key FROM pages")
def permalink_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    urn = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("urn:li:activity:"), F.col("page_id").cast("string"))).otherwise("")
    poster = F.concat(F.lit("Poster "), (F.col("page_id") % 50).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", permalink_cache_key(urn, F.lit(""), poster, F.col("html")).alias("cache_key"))


@query(r"SELECT page_id, regexp_replace(url, '[).,;]+$', '') || ' https://x.example/' || page_id AS urls FROM pages")
def urls_in_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("See "), F.col("url"), F.lit(" or (https://x.example/"), F.col("page_id").cast("string"), F.lit("), please."))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls_in_text(said), " ").alias("urls"))


_WORDS = "replace(replace(s_name, '#', '%23'), ' ', '+')"


@query(
    f"SELECT s_suppkey, '{SITE}/jobs/search/?keywords=' || {_WORDS} || '+intern&location=Pune&start=25&f_WT=2&f_TPR=r604800' AS jobs, "
    f"'{SITE}/search/results/content/?keywords=' || {_WORDS} || '+intern+Pune' || CASE WHEN s_suppkey % 2 = 0 THEN '&datePosted=%22past-week%22' ELSE '' END || '&sortBy=%22date_posted%22' AS content FROM supplier"
)
def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, bucket = F.concat("s_name", F.lit(" intern")), F.when(F.col("s_suppkey") % 2 == 0, "past-week")
    return table(spark, sf_dir, "supplier").select("s_suppkey", job_search_url(words, F.lit("Pune"), 25, True, 7).alias("jobs"), content_search_url(words, F.lit("Pune"), bucket).alias("content"))


@query("SELECT doc_id, trim(replace(replace(coalesce(text, ''), '|', '\\|'), chr(10), ' '), ' ') AS cell FROM documents")
def markdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", escape_markdown(F.col("text")).alias("cell"))


_NAME = f"array_to_string(string_split({_FOLDED.format('text')}, ' ')[1:2], ' ')"


@query(
    f"WITH n AS (SELECT DISTINCT {_NAME} AS target FROM benchmark), d AS (SELECT doc_id, ' ' || {_FOLDED.format('text')} || ' ' AS t FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, target FROM d JOIN n ON contains(t, ' ' || target || ' ') WHERE target <> ''"
)
def mentions_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents mention the first two words of which benchmark items."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    names = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(words, 1, 2), " ").alias("target")).where("target <> ''")
    return mention_join(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")), names, fold=folded)


@query("SELECT e.event_id, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE r_name END, '') AS company_class FROM events e LEFT JOIN nation ON n_nationkey = e.user_id % 30 LEFT JOIN region ON r_regionkey = n_regionkey")
def company_classes_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events labelled by the nation they name; a third of the nations is blank and told apart by nothing."""
    facts = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    classes = facts.where("n_nationkey % 3 <> 0").select(F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("name"), F.col("r_name").alias("category"), F.lit(0.9).alias("confidence"))
    posts = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" NATION "), (F.col("user_id") % 30).cast("string")).alias("company"), F.lit("").alias("poster"))
    return label_companies(posts, classes).select("event_id", "company_class")



@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'multi-company-openings' WHEN 1 THEN 'roundup-language' ELSE '' END AS signals, CASE doc_id % 4 WHEN 2 THEN 'source-spam:multi-role-dump' WHEN 3 THEN 'source-spam:group-invite' ELSE '' END AS reject FROM documents")
def spam_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of spam in front of whole documents."""
    own = F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))
    first = F.element_at(F.array(*map(F.lit, ("Company: Acme | x\nCompany: Zeta", "Job roundup", "plain", "plain"))), (F.col("doc_id") % 4 + 1).cast("int"))
    second = F.element_at(F.array(*map(F.lit, ("plain", "plain", "1. SDE intern at A\n2. ML intern at B", "Join my telegram group"))), (F.col("doc_id") % 4 + 1).cast("int"))
    reject = heuristic_reject(F.concat(second, own), F.lit("A"), F.lit("B"), F.lit("none"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(roundup_signals(F.concat(first, own)), ",").alias("signals"), reject.alias("reject"))


_JUDGED = """
WITH e AS (SELECT event_id, ['company_hiring', 'candidate_seeking', 'mention_only', 'company_hiring'][event_id % 4 + 1] AS intent, user_id % 3 <> 0 AS role_named,
  event_type IN ('purchase', 'click') AS hirer, coalesce(value > 50, false) AS offer, event_id % 7 = 0 AS roundup, event_id % 5 = 0 AS apply_text,
  user_id % 5 AS kind, CASE WHEN user_id % 2 = 1 THEN 'Other' ELSE '' END AS employer, event_id % 11 = 0 AS aff FROM events),
f AS (SELECT *, kind IN (1, 2) OR (apply_text AND NOT roundup) AS apply, kind = 3 AS elsewhere FROM e)
"""


@query(
    _JUDGED + "SELECT event_id, intent = 'company_hiring' AND role_named AND NOT roundup AND (apply OR (NOT elsewhere AND hirer AND offer AND (employer = '' OR aff))) AS keep, "
    "CASE WHEN intent = 'candidate_seeking' THEN 'gate:candidate_seeking' WHEN roundup THEN 'gate:roundup' WHEN employer <> '' AND NOT aff AND NOT apply THEN 'gate:employer_mismatch' "
    "WHEN elsewhere THEN 'gate:no_application_cta' WHEN NOT hirer THEN 'gate:not_hirer' ELSE 'gate:rejected' END AS reason FROM f"
)
def judged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of a verdict's flags, from the events' own columns."""
    pick = lambda values, by: F.element_at(F.array(*(v if isinstance(v, F.Column) else F.lit(v) for v in values)), (by + 1).cast("int"))
    event, user = F.col("event_id"), F.col("user_id")
    v = {
        "intent": pick(("company_hiring", "candidate_seeking", "mention_only", "company_hiring"), event % 4),
        "role_named": user % 3 != 0,
        "author_is_hirer": F.col("event_type").isin("purchase", "click"),
        "is_offer_not_request": F.coalesce(F.col("value") > 50, F.lit(False)),
    }
    text = F.when(event % 7 == 0, "1. ML intern at A\n2. SDE intern at B").when(event % 5 == 0, "Apply here").otherwise("text")
    categories = F.expr("cast(case user_id % 5 when 1 then array('ats_or_careers') when 2 then array('company_domain', 'unknown') when 3 then array('social_or_chat') else array() end as array<string>)")
    rest = (text, categories, F.lit(""), F.when(user % 2 == 1, "Other").otherwise(""), event % 11 == 0)
    return table(spark, sf_dir, "events").select("event_id", semantic_keep(v, *rest).alias("keep"), drop_reason(v, *rest).alias("reason"))


_FLAGS = ("author_is_hirer", "is_offer_not_request", "cta_is_application", "role_named")


@query(
    "SELECT event_id, (event_id % 5)::INT AS id, CASE WHEN event_id % 2 = 0 THEN 'company_hiring' ELSE 'mention_only' END AS intent, user_id % 2 = 0 AS role_named, event_type AS reason "
    "FROM events WHERE event_id % 5 < 4 AND event_id % 3 <> 0 AND event_id % 7 <> 0"
)
def strict_replies_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies made of events: an id out of range, a flag in quotes or an unknown intent drops the verdict."""
    event = F.col("event_id")
    intent = F.when(event % 7 == 0, "else").when(event % 2 == 0, "company_hiring").otherwise(" Mention_Only ")
    named = F.when(event % 3 == 0, F.lit('"true"')).otherwise((F.col("user_id") % 2 == 0).cast("string"))
    flags = F.concat(*(F.lit(f'"{k}":false,') for k in _FLAGS if k != "role_named"))
    reply = F.concat(F.lit('```json\n{"results":[{"id":'), (event % 5).cast("string"), F.lit(',"role_named":'), named, F.lit(","), flags, F.lit('"intent":"'), intent, F.lit('","reason":" '), F.col("event_type"), F.lit('"}]}\n```'))
    rows = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"), F.lit(4).alias("n"))
    return parse_strict(rows, "reply", "n").select("event_id", "id", "intent", "role_named", "reason")


@query(
    "SELECT event_id, (event_id % 5)::INT AS id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN user_id % 2 = 0 ELSE true END AS keep, event_type AS reason, "
    "CASE WHEN event_id % 6 = 0 THEN 'creator' WHEN event_id % 4 = 1 OR (event_id % 4 = 2 AND user_id % 2 = 1) THEN 'spam' WHEN event_id % 5 = 0 THEN 'company' ELSE 'employee' END AS source_type FROM events WHERE event_id % 5 < 4"
)
def tolerant_replies_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looser replies: truth values as words and numbers, types that are missing or misspelt."""
    event = F.col("event_id")
    keep = F.when(event % 4 == 0, F.lit('"keep":1')).when(event % 4 == 1, F.lit('"keep":false')).when(event % 4 == 2, F.concat(F.lit('"hiring_now":'), (F.col("user_id") % 2 == 0).cast("string"))).otherwise(F.lit('"keep":true'))
    kind = F.when(event % 6 == 0, ' Creator ').otherwise("what")
    reply = F.concat(F.lit('{"results":[{"id":"'), (event % 5).cast("string"), F.lit('",'), keep, F.lit(',"is_company_role":'), (event % 5 == 0).cast("string"), F.lit(',"source_type":"'), kind, F.lit('","reason":"'), F.col("event_type"), F.lit(' "}]}'))
    rows = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"), F.lit(4).alias("n"))
    return parse_tolerant(rows, "reply", "n").select("event_id", "id", "keep", "reason", "source_type")


_ROUNDS = "SELECT user_id, date_diff('day', ts::DATE, DATE '2024-01-31')::INT - 1 AS round, count(*) AS cards, count(*) FILTER (event_type = 'error') AS walls, max(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400e6 AS oldest FROM events WHERE ts < TIMESTAMP '2024-01-31' GROUP BY ALL"


@query(
    f"""WITH r AS ({_ROUNDS}), run AS (SELECT *, cards = lag(cards) OVER w AND cards = lag(cards, 2) OVER w AND round - 2 = lag(round, 2) OVER w AS flat FROM r WINDOW w AS (PARTITION BY user_id ORDER BY round)),
    j AS (SELECT *, CASE WHEN walls > 1 THEN 'login' WHEN oldest > 25 THEN 'age' WHEN flat THEN 'stagnant' WHEN round >= 27 THEN 'rounds' END AS reason FROM run),
    s AS (SELECT user_id, min(round) AS stop, arg_min(reason, round) AS reason FROM j WHERE reason IS NOT NULL GROUP BY user_id)
    SELECT user_id, round, cards, coalesce(s.reason, 'end') AS stopped_by FROM j LEFT JOIN s USING (user_id) WHERE s.stop IS NULL OR round < stop OR (round = stop AND s.reason <> 'login')"""
)
def scan_cuts_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a user as rounds of a scan, newest first: cut at a wall, at the age window, where it stagnates, or after 28 rounds."""
    end = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    events = table(spark, sf_dir, "events").where(F.col("ts") < end)
    rounds = events.groupBy("user_id", (F.datediff(F.lit("2024-01-31"), F.to_date("ts")) - 1).alias("round")).agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("event_type") == "error").alias("walls"), F.max((F.unix_micros(end) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86_400e6)).alias("oldest"))
    cut = cut_scan(rounds, ["user_id"], "round", before=[("login", F.col("walls") > 1)], after=[("age", F.col("oldest") > 25)], loaded="cards", most_rounds=28)
    return cut.select("user_id", "round", "cards", "stopped_by")


@query(
    """WITH c AS (SELECT o_custkey % 50 AS scan, (o_orderkey // 25 % 40)::INT AS round, o_orderkey AS pos, o_orderstatus AS title, o_orderpriority AS company, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1),
    e AS (SELECT scan, min(round) AS stop FROM (SELECT scan, round FROM c GROUP BY ALL HAVING count(*) FILTER (title = 'P') > 0) GROUP BY scan),
    k AS (SELECT c.* FROM c LEFT JOIN e USING (scan) WHERE stop IS NULL OR round < stop),
    f AS (SELECT scan, round, pos, l_partkey, row_number() OVER (PARTITION BY scan, l_partkey ORDER BY round, pos) AS n FROM k)
    SELECT scan, round, pos, 'https://www.linkedin.com/jobs/view/' || l_partkey || '/' AS link FROM f WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY scan ORDER BY round, pos) <= 20"""
)
def scan_listings_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings on pages: a page with a pending order is a wall; twenty different parts a scan."""
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    cards = table(spark, sf_dir, "orders").join(first, "o_orderkey").select((F.col("o_custkey") % 50).alias("scan"), (F.floor(F.col("o_orderkey") / 25) % 40).cast("int").alias("round"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("company"), F.lit("").alias("location"), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), "l_partkey", F.lit("/")).alias("link"))
    rounds = cards.groupBy("scan", "round").agg(F.count_if(F.col("title") == "P").alias("walls"))
    cut = cut_scan(rounds, ["scan"], "round", before=[("login", F.col("walls") > 0)])
    return scan_listings(cards, cut, ["scan"], "round", "pos", most=20).select("scan", "round", "pos", "link")


_FEEDBACK = """e AS (SELECT 'u' || user_id AS key, event_id AS seq, event_type IN ('click', 'error') AS is_label, CASE event_type WHEN 'click' THEN 'good' WHEN 'error' THEN 'bad' END AS label,
    '{"company":"Firm ' || user_id % 7 || '","poster":"' || event_type || '","kept":' || CASE WHEN value >= 50 THEN 'true' ELSE 'false' END || '}' AS row, event_type AS poster, value >= 50 AS kept, user_id % 7 AS firm FROM events),
    r AS (SELECT key, min(seq) AS first_seq, max(seq) AS at, arg_max(row, seq) AS row, arg_max(poster, seq) AS poster, arg_max(kept, seq) AS kept, min(firm) AS firm FROM e WHERE NOT is_label GROUP BY key),
    l AS (SELECT e.key, arg_max(e.label, e.seq) AS label FROM e JOIN r ON e.key = r.key WHERE e.is_label AND e.seq > r.at GROUP BY e.key),
    h AS (SELECT r.*, l.label FROM r LEFT JOIN l ON l.key = r.key)"""


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback on their user: clicks and errors are labels, the others rows of a history."""
    events = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    row = F.to_json(F.struct(F.concat(F.lit("Firm "), (F.col("user_id") % 7).cast("string")).alias("company"), F.col("event_type").alias("poster"), (F.col("value") >= 50).alias("kept")))
    label = F.when(F.col("event_type") == "click", "good").when(F.col("event_type") == "error", "Bad")
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), F.when(label.isNotNull(), "label").otherwise("row").alias("kind"), F.coalesce(label, row).alias("row"))


@query(f"WITH {_FEEDBACK} SELECT key, first_seq, row, label FROM h")
def feedback_history_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key with its first place and the label given since."""
    return history_of(_feedback(spark, sf_dir))


@query(
    f"""WITH {_FEEDBACK}, p AS (SELECT 'firm ' || firm AS company_key, poster, count(*) FILTER (kept OR label = 'good') AS positives, count(*) FILTER (NOT kept OR label = 'bad') AS negatives,
    coalesce(bool_or(label = 'good'), false) AS good, coalesce(bool_or(label = 'bad'), false) AS bad FROM h GROUP BY ALL)
    SELECT company_key, poster, positives, negatives, (positives >= 2 OR good) AND NOT (negatives >= 2 OR bad) AS trusted, negatives >= 2 OR bad AS blocked FROM p"""
)
def feedback_profiles_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted and blocked posters of the history, as sums over its changes."""
    return profiles_of(history_of(_feedback(spark, sf_dir)).withColumn("sign", F.lit(1)))
