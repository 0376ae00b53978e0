"""Queries over ``events``: ages, buckets, history, profiles, batches, ranks.

The table stands in for gate history: a user is a poster, an event type is the
outcome, and ``purchase`` and ``signup`` are good ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.dates import age_days, date_bucket, humanised, is_recent
from siftwell.operators.funnel import batch_numbers, is_monotonic, keep_first, limit_per_key, merge_variations
from siftwell.operators.history import apply_labels, history_key, labelled_examples, opening_domains, poster_profiles, screen_posters, upsert
from siftwell.operators.verdicts import join_verdicts, kept_rank
from siftwell.plans.registry import query, table
from siftwell.sinks.writers import group_index

AS_OF = "2024-01-31 00:00:00"
_AGE = "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400e6"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("days", age_days(F.col("ts"), F.to_timestamp(F.lit(AS_OF))))


@query(f"SELECT event_id FROM events WHERE greatest(0, {_AGE}) <= 7")
def recency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the exact rule, and a wider one on the stored column that the scan can use
    recent = _events(spark, sf_dir).where("ts >= timestamp_ntz'2024-01-23 00:00:00'")
    return recent.where(is_recent(F.col("days"), 7, False)).select("event_id")


@query(f"SELECT event_id, CASE WHEN d < 1.0/24 THEN trunc(d * 1440)::BIGINT || 'm ago' WHEN d < 1 THEN trunc(d * 24)::BIGINT || 'h ago' WHEN d < 7 THEN trunc(d)::BIGINT || 'd ago' WHEN d < 30 THEN trunc(d / 7)::BIGINT || 'w ago' ELSE trunc(d / 30.44)::BIGINT || 'mo ago' END AS age FROM (SELECT event_id, greatest(0, {_AGE}) AS d FROM events)")
def age_humanised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", humanised(F.col("days")).alias("age"))


@query(f"SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d <= 1 THEN 'past-24h' WHEN d <= 7 THEN 'past-week' WHEN d <= 31 THEN 'past-month' END AS bucket FROM (SELECT greatest(0, {_AGE}) AS d FROM events)) GROUP BY bucket")
def date_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(date_bucket(F.col("days")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT min(d) AS youngest, max(d) AS oldest FROM (SELECT greatest(0, {_AGE}) AS d FROM events)")
def age_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).agg(F.min("days").alias("youngest"), F.max("days").alias("oldest"))


@query("SELECT user_id, max(value) FILTER (event_type = 'click') AS clicks, max(value) FILTER (event_type = 'view') AS views, max(value) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY user_id")
def engagement_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(most("click").alias("clicks"), most("view").alias("views"), most("purchase").alias("purchases"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') = 'BOOLEAN' AS is_flag FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.try_parse_json("props")
    kind = F.schema_of_variant(F.try_variant_get(props, "$.k", "variant"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(props, "$.k", "bigint").alias("k"), (kind == "BOOLEAN").alias("is_flag"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of history rows."""
    good = F.col("event_type").isin("purchase", "signup")
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.concat(F.lit("Unit "), (F.col("user_id") % 5).cast("string"), F.lit(" Labs")).alias("company"),
        F.concat(F.lit("User "), (F.col("event_id") % 3001).cast("string")).alias("poster"),
        F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("https://x.example/"), (F.col("event_id") % 997).cast("string"))).alias("post_url"),
        good.alias("kept"),
        F.col("event_type").alias("gate_reason"),
        F.when(F.col("event_id") % 41 == 0, F.when(good, "good").otherwise("bad")).otherwise("").alias("user_label"),
        F.lit("other").alias("intent"),
        F.array(F.concat(F.lit("h"), (F.col("event_id") % 7).cast("string"), F.lit(".example"))).alias("link_domains"),
        F.col("event_id").alias("seq"),
    )


_HISTORY = "h AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, 'Unit ' || user_id % 5 || ' Labs' AS company, 'unit ' || user_id % 5 AS company_key, 'User ' || event_id % 3001 AS poster, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'https://x.example/' || event_id % 997 END AS post_url, event_type IN ('purchase', 'signup') AS kept, event_type AS gate_reason, CASE WHEN event_id % 41 = 0 THEN CASE WHEN event_type IN ('purchase', 'signup') THEN 'good' ELSE 'bad' END ELSE '' END AS user_label, 'h' || event_id % 7 || '.example' AS domain, event_id AS seq FROM events)"
_KEYED = f"WITH {_HISTORY}, k AS (SELECT *, CASE WHEN post_url <> '' THEN post_url ELSE lower(company) || '|' || lower(poster) || '|' || gate_reason END AS key FROM h)"


@query(f"{_KEYED} SELECT key, max(seq) AS last_seq, min(seq) AS first_seq, arg_max(poster, seq) AS poster, arg_max(kept, seq) AS kept FROM k GROUP BY key")
def history_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir).withColumn("key", history_key(F.col("post_url"), F.col("company"), F.col("poster"), F.col("gate_reason")))
    return upsert(rows, "key", "seq").select("key", F.col("seq").alias("last_seq"), "first_seq", "poster", "kept")


_PROFILE = f"WITH {_HISTORY}, p AS (SELECT company_key, lower(poster) AS poster, count(*) FILTER (kept OR user_label = 'good') AS positives, count(*) FILTER (NOT kept OR user_label = 'bad') AS negatives, bool_or(user_label = 'good') AS g, bool_or(user_label = 'bad') AS b FROM h GROUP BY ALL), f AS (SELECT company_key, poster, positives, negatives, (positives >= 2 OR g) AND NOT (negatives >= 2 OR b) AS trusted, negatives >= 2 OR b AS blocked FROM p)"


@query(f"{_PROFILE} SELECT * FROM f")
def poster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poster_profiles(_history(spark, sf_dir))


@query(f"{_PROFILE} SELECT h.seq, f.trusted AS trusted FROM h JOIN f ON h.company_key = f.company_key AND lower(h.poster) = f.poster WHERE NOT f.blocked")
def blocked_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir)
    screened = screen_posters(rows.select("seq", "company", "poster"), poster_profiles(rows))
    return screened.where("not poster_blocked").select("seq", (F.col("profile_prior") == "trusted_poster").alias("trusted"))


@query(f"WITH {_HISTORY} SELECT company_key, seq FROM (SELECT company_key, seq, row_number() OVER (PARTITION BY company_key ORDER BY timestamp DESC, post_url) AS n FROM h WHERE user_label <> '') WHERE n <= 4")
def latest_four_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_examples(_history(spark, sf_dir)).select("company_key", "seq")


@query(f"WITH {_HISTORY} SELECT company_key, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM h WHERE kept OR user_label = 'good' GROUP BY company_key")
def profile_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opening_domains(_history(spark, sf_dir)).select("company_key", F.array_join("domains", ",").alias("domains"))


@query(f"WITH {_HISTORY}, l AS (SELECT post_url, arg_max(gate_reason, seq) AS r, max(seq) AS s FROM h WHERE seq % 5 = 0 AND post_url <> '' AND gate_reason IN ('click', 'error') GROUP BY post_url) SELECT h.seq, CASE WHEN l.r = 'click' THEN 'good' WHEN l.r = 'error' THEN 'bad' ELSE user_label END AS user_label, l.r IS NOT NULL AS relabelled FROM h LEFT JOIN l ON h.post_url = l.post_url")
def label_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir)
    labels = rows.where("seq % 5 = 0 and gate_reason in ('click', 'error')").select("post_url", F.when(F.col("gate_reason") == "click", "Good").otherwise("bad").alias("label"), "seq")
    out = apply_labels(rows.select("seq", "post_url", "user_label", "timestamp"), labels, AS_OF)
    return out.select("seq", "user_label", (F.col("timestamp") == AS_OF).alias("relabelled"))


@query("SELECT event_id, user_id, (row_number() OVER w - 1) // 5 AS batch, ((row_number() OVER w - 1) % 5)::INT AS id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def gate_batches_of_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_numbers(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "user_id", "batch", "id")


@query("WITH b AS (SELECT event_id, user_id, event_type, (row_number() OVER w - 1) // 5 AS batch, ((row_number() OVER w - 1) % 5)::INT AS id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, id < 4 AS judged, CASE WHEN id < 4 THEN event_type = 'purchase' END AS keep FROM b")
def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = batch_numbers(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5).withColumn("company", F.col("user_id"))
    verdicts = batched.where("id < 4").select("company", "batch", "id", (F.col("event_type") == "purchase").alias("keep"))
    return join_verdicts(batched, verdicts).select("event_id", "judged", "keep")


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 9 END AS rank FROM events")
def source_rank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"purchase": "company", "signup": "employee", "click": "recruiter", "view": "creator"}
    kind = F.create_map(*(F.lit(x) for p in kinds.items() for x in p))[F.col("event_type")]
    return table(spark, sf_dir, "events").select("event_id", kept_rank(F.coalesce(kind, F.lit("spam"))).alias("rank")).orderBy("rank", "event_id")


@query("WITH g AS (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS f, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'purchase') SELECT event_id, user_id, n AS group_size, row_number() OVER (ORDER BY f, event_id) AS out_index FROM g")
def first_seen_group_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("g", F.col("user_id").cast("string"))
    return group_index(rows, "g", "event_id").select("event_id", "user_id", "group_size", F.col("out_index").cast("long").alias("out_index"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def limit_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id")


@query("SELECT user_id, arg_min(event_id, (CASE event_type WHEN 'click' THEN 0 ELSE 1 END) * 1000000000 + event_id) AS event_id FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def merge_query_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    parts = [e.where(F.col("event_type") == k) for k in ("click", "view")]
    return merge_variations(parts, ["user_id"], "event_id").select("user_id", "event_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def keep_first_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("SELECT user_id, count(*) AS seen, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type NOT IN ('error', 'view')) AS sent, count(*) FILTER (event_type = 'purchase') AS kept, true AS monotonic FROM events GROUP BY user_id")
def funnel_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(kind != "error").alias("passed"), F.count_if(~kind.isin("error", "view")).alias("sent"), F.count_if(kind == "purchase").alias("kept"))
    return out.withColumn("monotonic", is_monotonic(F.col("seen"), F.col("passed"), F.col("sent"), F.col("kept")))
