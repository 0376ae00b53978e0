"""Rules that need language the tables don't have, on inline rows.

Expected answers are worked out by hand from the rules; they prove semantics, not scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.dates import humanised, iso_age_days, relative_age
from siftwell.functions.entities import affiliated, employer
from siftwell.functions.text import clean_name, engagement, follower_count, format_followers, is_more_label, is_truncated, without_doubling
from siftwell.functions.urls import canonical_permalink, classify_links, is_exact_post, job_id, job_link, link_kind, unwrapped, urls_in_text
from siftwell.operators.matching import Vocabulary, candidate_net, funding_mentions, match_terms, strong_match
from siftwell.operators.provenance import audit_tokens, engagement_signal, first_party, heuristic_reject, roundup_signals, spam_signals
from siftwell.operators.search_terms import is_prose
from siftwell.operators.verdicts import drop_reason, parse_strict, parse_tolerant, salvage, semantic_keep, verdict_source_type
from siftwell.operators.walks import company_walk, fill_permalinks, gate_batches, haystack, history_rows, is_startup, keyword_posts, label_companies, mention_join, relevance_gate, semantic_gate
from siftwell.plans.registry import case
from siftwell.schemas import HISTORY, POST, conform
from siftwell.sinks.writers import result_row, text_block


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def expected(columns: str, rows: Sequence[tuple]) -> str:
    """SQL that returns the expected rows; ``columns`` are ``name TYPE`` pairs."""
    names = [c.split()[0] for c in columns.split(", ")]
    casts = ", ".join(f"CAST({n} AS {c.split()[1]}) AS {n}" for n, c in zip(names, columns.split(", "), strict=True))
    values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    return f"SELECT {casts} FROM (VALUES {values}) v({', '.join(names)})"


def _frame(spark: SparkSession, ddl: str, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


_DATES = [
    ("2d", 2.0), ("3 weeks ago", 21.0), ("1mo", 30.44), ("5 hours ago", 5 / 24), ("yesterday", 1.0), ("just now", 0.0), ("today", 0.0),
    ("10m", 10 / 1440), ("1 yr", 365.25), ("you know", 0.0), ("posted today, 3d", 3.0), ("yesterday 5d", 1.0), ("no date", None), ("", None),
]


@case(expected("text VARCHAR, days DOUBLE", [(t, None if d is None else d) for t, d in _DATES]))
def fixture_relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, "text string", [(t,) for t, _ in _DATES]).select("text", relative_age(F.col("text")).alias("days"))


_AGES = [(0.01, "14m ago"), (0.5, "12h ago"), (3.9, "3d ago"), (8.0, "1w ago"), (30.0, "0mo ago"), (61.0, "2mo ago"), (None, "unknown")]


@case(expected("days DOUBLE, age VARCHAR", _AGES))
def fixture_humanised_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, "days double", [(d,) for d, _ in _AGES]).select("days", humanised(F.col("days")).alias("age"))


_STAMPS = [("2024-01-30T00:00:00Z", 1.0), ("2024-01-30T12:00:00", 0.5), ("2024-02-01T00:00:00+00:00", 0.0), ("soon", None), ("", None)]


@case(expected("stamp VARCHAR, days DOUBLE", _STAMPS))
def fixture_iso_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, "stamp string", [(s,) for s, _ in _STAMPS]).select("stamp", iso_age_days(F.col("stamp"), F.to_timestamp(F.lit("2024-01-31 00:00:00"))).alias("days"))


_URLS = [
    ("https://boards.greenhouse.io/acme/jobs/1", "", "careers"), ("https://sarvam.ai/blog", "Sarvam AI", "careers"), ("https://chat.whatsapp.com/inviteXXX", "", "junk"),
    ("https://example.org/about", "Acme", "unknown"), ("https://acme.com/careers/12", "Other", "careers"), ("https://www.linkedin.com/groups/12/", "", "junk"),
    ("https://www.linkedin.com/jobs/view/42/", "", "careers"), ("https://x.example/join-group", "", "unknown"), ("https://x.example/community", "", "junk"), ("", "Acme", "unknown"),
]


@case(expected("url VARCHAR, company VARCHAR, kind VARCHAR", _URLS))
def fixture_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, "url string, company string", [r[:2] for r in _URLS]).select("url", "company", link_kind(F.col("url"), F.col("company")).alias("kind"))


_SETS = [
    (1, ["https://chat.whatsapp.com/a", "https://boards.greenhouse.io/b"], "careers", 2, "link:junk:chat.whatsapp.com; link:careers:boards.greenhouse.io"),
    (2, ["https://chat.whatsapp.com/a", "https://x.example/1"], "junk", 2, "link:junk:chat.whatsapp.com; link:unknown:x.example"),
    (3, ["/in/someone", "#top"], "none", 0, ""),
    (4, ["https://X.example/1/", "https://x.example/1"], "unknown", 1, "link:unknown:x.example"),
]


@case(expected("id BIGINT, kind VARCHAR, n INTEGER, reasons VARCHAR", [(r[0], r[2], r[3], r[4]) for r in _SETS]))
def fixture_link_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _frame(spark, "id long, urls array<string>", [r[:2] for r in _SETS]).withColumn("v", classify_links(F.col("urls"), F.lit("Acme")))
    return v.select("id", F.col("v.kind").alias("kind"), F.size("v.urls").alias("n"), F.array_join("v.reasons", "; ").alias("reasons"))


_IN_TEXT = [("Apply: https://a.example/x). More at www.b.example, or lnkd.in/abc", "https://a.example/x https://www.b.example lnkd.in/abc"), ("none here", ""), ("https://a.example/ https://A.example", "https://a.example/")]


@case(expected("text VARCHAR, urls VARCHAR", _IN_TEXT))
def fixture_urls_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, "text string", [(t,) for t, _ in _IN_TEXT]).select("text", F.array_join(urls_in_text(F.col("text")), " ").alias("urls"))


_FOLLOWERS = [("31k+ LinkedIn", 31000, "31k"), ("1,234 followers", 1234, "1.2k"), ("2.5M followers", 2500000, "2.5m"), ("12 linkedin followers", 12, "12"), ("no count", None, None)]


@case(expected("text VARCHAR, followers BIGINT, short VARCHAR", _FOLLOWERS))
def fixture_follower_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = follower_count(F.col("text"))
    return _frame(spark, "text string", [(t,) for t, *_ in _FOLLOWERS]).select("text", n.alias("followers"), format_followers(n).alias("short"))


_SITE = "https://www.linkedin.com"
_PERMALINKS = [
    ("/feed/update/urn%3Ali%3Aactivity%3A7489706814855344128/?reshareId=1", f"{_SITE}/feed/update/urn:li:activity:7489706814855344128/", True),
    (f"{_SITE}/posts/someone_x-ugcPost-7500642672152526848-abc/?utm=1", f"{_SITE}/feed/update/urn:li:ugcPost:7500642672152526848/", True),
    (f"{_SITE}/feed/update/urn:li:activity:15001071693790879744/", "", False),
    (f"{_SITE}/feed/update/urn:li:activity:123/", "", False),
    (f"{_SITE}/search/results/content/?keywords=x", "", False),
    (f"{_SITE}/in/someone/", "", False),
    ("", "", False),
]


@case(expected("raw VARCHAR, permalink VARCHAR, exact BOOLEAN", _PERMALINKS))
def fixture_permalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _frame(spark, "raw string", [(r[0],) for r in _PERMALINKS]).select("raw", canonical_permalink(raw).alias("permalink"), is_exact_post(raw).alias("exact"))


_JOBS = [
    (["https://www.linkedin.com/jobs/", "https://www.linkedin.com/jobs/view/77/?trk=1"], "https://www.linkedin.com/jobs/view/77/", "77"),
    (["https://www.linkedin.com/safety/go/?url=https%3A%2F%2Facme.example%2Fjob%3Fa%3D1&x=2"], "https://acme.example/job", "https://acme.example/job"),
    (["https://lnkd.in/abc"], "https://lnkd.in/abc", "https://lnkd.in/abc"),
    (["https://acme.example/"], "", ""),
]


@case(expected("link VARCHAR, id VARCHAR", [r[1:] for r in _JOBS]))
def fixture_job_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, "links array<string>", [(r[0],) for r in _JOBS]).select(job_link(F.col("links")).alias("link")).select("link", job_id(F.col("link")).alias("id"))


@case(expected("raw VARCHAR, target VARCHAR", [("https://x.example/a", "https://x.example/a"), ("/safety/go/?url=https%3A%2F%2Fy.example%2F", "https://y.example/")]))
def fixture_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, "raw string", [("https://x.example/a",), ("/safety/go/?url=https%3A%2F%2Fy.example%2F",)]).select("raw", unwrapped(F.col("raw")).alias("target"))


_NAMES = [
    ("Asha Rao 3rd+ • 2d • Edited", "Asha Rao 3rd+ • 2d • Edited", "Asha Rao"), ("Acme Corp Acme Corp", "Acme Corp", "Acme Corp"),
    ("Asha\nAsha\n  2nd  ", "Asha 2nd", "Asha"), (" · Lee — ", "Lee", "Lee"), ("", "", ""),
]


@case(expected("raw VARCHAR, line VARCHAR, name VARCHAR", _NAMES))
def fixture_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _frame(spark, "raw string", [(r[0],) for r in _NAMES]).select("raw", without_doubling(raw).alias("line"), clean_name(raw).alias("name"))


_LABELS = [("…see more", True, False), ("See  More", True, False), ("more jobs", False, False), ("and so on...", False, True), ("cut off… more", False, True)]


@case(expected("text VARCHAR, label BOOLEAN, truncated BOOLEAN", _LABELS))
def fixture_more_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, "text string", [(r[0],) for r in _LABELS]).select("text", is_more_label(F.col("text")).alias("label"), is_truncated(F.col("text")).alias("truncated"))


_ENGAGED = [("12 reactions 3 comments 1,200 likes", 1200, 3, 0, ""), ("0 likes 0 comments", 0, 0, 0, "zero_engagement_multiple_shorteners"), ("quiet", None, None, None, "")]


@case(expected("text VARCHAR, likes BIGINT, comments BIGINT, reposts BIGINT, signal VARCHAR", _ENGAGED))
def fixture_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _frame(spark, "text string", [(r[0],) for r in _ENGAGED]).withColumn("e", engagement(F.col("text")))
    links = F.array(F.lit("https://lnkd.in/a"), F.lit("https://lnkd.in/b"))
    return e.select("text", *(F.try_element_at("e", F.lit(k)).alias(k) for k in ("likes", "comments", "reposts")), engagement_signal(F.col("e"), links).alias("signal"))


_EMPLOYERS = [("SWE @ Razorpay", "Razorpay", True), ("Student | BITS '27", "", False), ("Engineer at Acme Labs | ML", "Acme Labs", False), ("Hiring manager at razorpay", "", False), ("", "", False)]


@case(expected("headline VARCHAR, employer VARCHAR, affiliated BOOLEAN", _EMPLOYERS))
def fixture_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("headline")
    return _frame(spark, "headline string", [(r[0],) for r in _EMPLOYERS]).select("headline", employer(h).alias("employer"), affiliated(h, F.lit("Razorpay India")).alias("affiliated"))


_MATCHES = [
    ("We're hiring an AI intern to work on LLM eval pipelines. Apply now.", True, "hiring:hiring, we're hiring, apply now; role:intern; domain:ai, llm"),
    ("We're hiring an HR intern. Apply now.", False, "hiring:hiring, we're hiring, apply now; role:intern; domain:none"),
    ("We're hiring an intern for html work. Apply now.", False, "hiring:hiring, we're hiring, apply now; role:intern; domain:none"),
    ("", False, "no post text"),
]


@case(expected("post_text VARCHAR, matched BOOLEAN, why VARCHAR", _MATCHES))
def fixture_term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, "post_text string", [(r[0],) for r in _MATCHES])
    return match_terms(rows, "post_text", Vocabulary()).select("post_text", "matched", F.array_join("reasons", "; ").alias("why"))


_STRONG = [
    ("We're hiring an AI intern at Razorpay to work on ML fraud models. Apply now.", "Razorpay", True, "company:Razorpay; hiring:we're hiring; role:intern; domain:ai; proximity:hire+intern≤15w; offer:we're hiring~intern~ai"),
    ("Last year as an intern I learned a lot about AI at Razorpay. We're hiring.", "Razorpay", False, "company:Razorpay; hiring:hiring, we're hiring; role:intern; domain:ai; proximity:intern only in narrative/program phrasing"),
    ("We're hiring an AI intern. Apply now.", "Razorpay", False, "company:none; hiring:we're hiring; role:intern; domain:ai; proximity:hire+intern≤15w; offer:we're hiring~intern~ai"),
    ("Razorpay internship module for ML. Looking for learners.", "Razorpay", False, "company:Razorpay; hiring:looking for; role:internship; domain:ml; proximity:intern only in narrative/program phrasing"),
    ("  ", "Razorpay", False, "company:none; hiring:none; role:none; domain:none; proximity:none"),
]


@case(expected("post_text VARCHAR, matched BOOLEAN, why VARCHAR", [(r[0], r[2], r[3]) for r in _STRONG]))
def fixture_strong_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, "post_text string, company string", [r[:2] for r in _STRONG])
    return strong_match(rows, F.col("company"), F.col("post_text")).select("post_text", "matched", F.array_join("reasons", "; ").alias("why"))


_NET = [
    ("Razorpay has an internship.", "Razorpay", True, "company:Razorpay; hiring:none; role:internship"),
    ("I completed my internship at Razorpay!", "Razorpay", False, "company:Razorpay; candidate_terms:internship; celebration:obvious"),
    ("An internship somewhere.", "Razorpay", False, "company:none; hiring:none; role:internship"),
]


@case(expected("post_text VARCHAR, matched BOOLEAN, why VARCHAR", [(r[0], r[2], r[3]) for r in _NET]))
def fixture_candidate_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, "post_text string, company string", [r[:2] for r in _NET])
    return candidate_net(rows, F.col("company"), F.col("post_text")).select("post_text", "matched", F.array_join("reasons", "; ").alias("why"))


_FUNDED = [
    ("A pre-seed stage startup, backed by Sequoia and Accel. We raised $5 million last year.", "pre-seed|backed by Sequoia and Accel|raised $5 million"),
    ("Series A, series a and YC W24", "Series A|YC W24"),
    ("nothing", ""),
]


@case(expected("text VARCHAR, phrases VARCHAR", _FUNDED))
def fixture_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, "text string", [(r[0],) for r in _FUNDED]).select("text", F.array_join(funding_mentions(F.col("text")), "|").alias("phrases"))


_SPAM = [
    ("DM me for a referral", "A", "B", "none", "dm-for-referral", ""),
    ("Join my telegram group", "A", "B", "unknown", "group-invite", "source-spam:group-invite"),
    ("Acme is hiring. Zeta now hiring too", "", "", "none", "multi-company-openings", ""),
    ("1. SDE intern at A\n2. ML intern at B", "", "", "none", "multi-role-dump", "source-spam:multi-role-dump"),
    ("hello", "", "", "junk", "group-invite", "junk-link:group-invite"),
    ("I'm hiring, dm me", "Sam", "Acme", "none", "generic-dm-hire,not-hiring-company", ""),
    ("#hiring #intern Top tech openings", "", "", "none", "roundup-language", ""),
]


@case(expected("text VARCHAR, signals VARCHAR, reject VARCHAR", [(r[0], r[4], r[5]) for r in _SPAM]))
def fixture_spam_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col(c) for c in ("text", "poster", "company", "kind")]
    return _frame(spark, "text string, poster string, company string, kind string", [r[:4] for r in _SPAM]).select("text", F.array_join(spam_signals(*cols), ",").alias("signals"), heuristic_reject(*cols).alias("reject"))


@case(expected("text VARCHAR, signals VARCHAR", [("Company: Acme | x\nCompany: Zeta", "multi-company-openings"), ("Job roundup", "roundup-language"), ("plain", "")]))
def fixture_roundups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("Company: Acme | x\nCompany: Zeta",), ("Job roundup",), ("plain",)]
    return _frame(spark, "text string", rows).select("text", F.array_join(roundup_signals(F.col("text")), ",").alias("signals"))


_FIRST = [
    (1, "Asha", "SWE @ Microsoft", "Microsoft is hiring a software engineering intern. Comment for referral.", True, "employee", True, "real opening (target named as hiring org; role+apply path)"),
    (2, "Jobs Daily", "", "Microsoft is hiring interns. Apply now.", True, "aggregator", False, "aggregator account (Jobs Daily)"),
    (3, "Jobs Daily", "", "Microsoft is hiring interns. Apply now.", False, "aggregator", True, "loose mode: company mentioned, poster unverified"),
    (4, "Sam", "31k+ LinkedIn", "Microsoft is hiring an AI intern https://careers.microsoft.com/x", True, "creator", True, "real opening (target named as hiring org; role+apply path)"),
    (5, "Sam", "Writer", "Microsoft is hiring. 3+ years of experience needed.", True, "creator", False, "experienced role, not an internship opening"),
    (6, "Sam", "Writer", "I like Microsoft.", True, "creator", False, "off-topic: target mentioned but not as the hiring org"),
    (7, "Sam", "Writer", "Microsoft is hiring people.", True, "creator", False, "no concrete opening (missing specific role + apply path)"),
    (8, "Microsoft", "", "Role: data intern in Pune", True, "company", False, "no concrete opening (missing apply path)"),
    (9, "Microsoft", "Verified", "Role: data intern in Pune", True, "company", True, "borderline opening rescued by poster credibility (verified)"),
    (10, "", "", "Join my community", True, "spam", False, "community / paid-service spam, no real role"),
]


@case(expected("id BIGINT, source_type VARCHAR, keep BOOLEAN, why VARCHAR", [(r[0], *r[5:]) for r in _FIRST]))
def fixture_first_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, "id long, poster string, headline string, text string, strict boolean", [r[:5] for r in _FIRST])
    none = F.expr("cast(array() as array<string>)")
    made = [first_party(rows.where(F.col("strict") == s), F.lit("Microsoft"), F.col("poster"), F.col("headline"), F.col("text"), none, strict=s) for s in (True, False)]
    return made[0].unionByName(made[1]).select("id", "source_type", "keep", F.col("keep_reason").alias("why"))


@case(expected("tokens VARCHAR", [("poster:Asha; followers:31k; verified:yes; source:creator (ok)",), ("poster:(unknown)",)]))
def fixture_audit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, "p string, h string, s string, r string, t string", [("Asha", "31k+ LinkedIn, verified", "creator", "ok", "x"), ("", "", "", "", "")])
    return rows.select(F.array_join(audit_tokens(*(F.col(c) for c in "phsrt")), "; ").alias("tokens"))


_REPLY = '```json\n{"results":[{"id":0,"keep":"false","reason":" a ","source_type":"Farmer"},{"id":"1","keep":false,"reason":"b"},{"id":2,"hiring_now":1,"is_company_role":true},{"id":9,"keep":true},{"id":3,"keep":true,"source_type":"creator"},{"id":3,"keep":0}]}\n```'
_TOLERANT = [(0, True, "a", "spam"), (1, False, "b", "spam"), (2, True, "", "company"), (3, False, "", "spam")]


@case(expected("id INTEGER, keep BOOLEAN, reason VARCHAR, source_type VARCHAR", _TOLERANT))
def fixture_verdict_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, "reply string, n int", [(_REPLY, 4), ("not json", 4)])
    return parse_tolerant(rows, "reply", "n").select("id", "keep", "reason", "source_type")


def _strict_row(i: object, **other: object) -> str:
    import json

    return json.dumps({"id": i, "author_is_hirer": True, "is_offer_not_request": True, "cta_is_application": False, "role_named": True, "intent": "company_hiring", "reason": "r"} | other)


_STRICT_REPLY = "{\"results\":[" + ",".join([_strict_row(0), _strict_row("1", intent=" Mention_Only "), _strict_row(2, role_named="true"), _strict_row(3, intent="else"), _strict_row(7)]) + "]}"


@case(expected("kind VARCHAR, id INTEGER, intent VARCHAR, role_named BOOLEAN, reason VARCHAR", [("plain", 0, "company_hiring", True, "r"), ("plain", 1, "mention_only", True, "r"), ("chatty", 0, "company_hiring", True, "r"), ("chatty", 1, "mention_only", True, "r")]))
def fixture_verdict_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, "kind string, reply string, n int", [("plain", _STRICT_REPLY, 5), ("chatty", f"Sure {{ok}}: {_STRICT_REPLY} bye", 5)])
    fixed = rows.withColumn("reply", F.when(F.col("kind") == "chatty", salvage(F.col("reply"))).otherwise(F.col("reply")))
    return parse_strict(fixed, "reply", "n").select("kind", "id", "intent", "role_named", "reason")


_KEEP = [
    (1, "company_hiring", True, True, True, "Apply here", ["ats_or_careers"], "", "", False, True, "gate:rejected", "third_party_with_apply_link"),
    (2, "company_hiring", True, True, True, "text", ["social_or_chat"], "", "", False, False, "gate:no_application_cta", "third_party_with_apply_link"),
    (3, "company_hiring", True, True, True, "text", [], "", "Other", False, False, "gate:employer_mismatch", "third_party_with_apply_link"),
    (4, "company_hiring", True, True, True, "text", [], "", "Acme", True, True, "gate:rejected", "employee"),
    (5, "candidate_seeking", True, True, True, "Apply here", [], "", "", False, False, "gate:candidate_seeking", "third_party_with_apply_link"),
    (6, "company_hiring", False, True, True, "text", [], "careers", "", False, False, "gate:rejected", "third_party_with_apply_link"),
    (7, "company_hiring", True, False, True, "text", [], "", "", False, False, "gate:not_hirer", "third_party_with_apply_link"),
    (8, "company_hiring", True, True, True, "1. ML intern at A\n2. SDE intern at B", ["company_domain"], "", "", False, False, "gate:roundup", "third_party_with_apply_link"),
]


@case(expected("id BIGINT, keep BOOLEAN, reason VARCHAR, source VARCHAR", [(r[0], *r[10:]) for r in _KEEP]))
def fixture_semantic_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = "id long, intent string, role_named boolean, author_is_hirer boolean, is_offer_not_request boolean, text string, categories array<string>, link_class string, employer string, aff boolean"
    rows = _frame(spark, ddl, [r[:10] for r in _KEEP])
    v = {c: F.col(c) for c in ("intent", "role_named", "author_is_hirer", "is_offer_not_request")}
    rest = [F.col(c) for c in ("text", "categories", "link_class", "employer", "aff")]
    return rows.select("id", semantic_keep(v, *rest).alias("keep"), drop_reason(v, *rest).alias("reason"), verdict_source_type(F.lit(""), F.col("author_is_hirer"), F.col("aff"), F.lit("Engineer")).alias("source"))


_PROSE = [("acme intern", False), ("two\nlines", True), ("w " * 23, True), ("x" * 161, True), ("One. Two. " + "y" * 75, True), ("", False)]


@case(expected("query VARCHAR, prose BOOLEAN", _PROSE))
def fixture_prose_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, "query string", [(r[0],) for r in _PROSE]).select("query", is_prose(F.col("query")).alias("prose"))


@case(expected("block VARCHAR", [("--- 1 ---\ncompany: Acme\nrole: ML intern wanted\nwhy_matched: a; gate_reason:good\npost_url: ",), ("--- 2 ---\ncompany: Sam\nrole: SDE\nwhy_matched: has good\npost_url: u\nsource_type: creator",)]))
def fixture_result_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = "n int, company string, poster string, role string, snippet string, why_matched string, gate_reason string, post_url string, source_type string"
    rows = _frame(spark, ddl, [(1, "Acme", "P", "", "ML  intern wanted", "a", "good", "", ""), (2, "", "Sam", "SDE", "x", "has good", "good", "u", "creator")])
    flat = rows.select("n", F.struct(*rows.columns[1:]).alias("r")).select("n", "r.*")
    made = result_row(flat.drop("n")).withColumn("n", F.when(F.col("company") == "Acme", 1).otherwise(2))
    return made.select(text_block(("company", "role", "why_matched", "post_url", "source_type"), F.col("n"), skip_blank=("source_type",)).alias("block"))


def _posts(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Posts from ``seq, poster, headline, text, url, links, days``."""
    made = _frame(spark, "seq long, poster string, poster_headline string, post_text string, post_url string, outbound_links array<string>, days_old double", rows)
    blank = made.withColumns({f.name: F.lit(None).cast(f.dataType) for f in POST if f.name not in made.columns}).na.fill("")
    return blank.withColumn("link_categories", F.expr("cast(array() as array<string>)"))


_ATS = ["https://boards.greenhouse.io/acme/jobs/1"]
_HIRE = "Acme is hiring an AI intern. We're hiring now, apply here."
_WALK = [
    (1, "Asha", "SWE @ Acme", _HIRE, "", _ATS, 2.0),
    (2, "Asha", "SWE @ Acme", _HIRE.replace(" ", "  "), "", _ATS, 3.0),
    (3, "Bo", "Writer", "I admire Acme and Zeta Labs.", "", [], 1.0),
    (4, "Cy", "Writer", _HIRE, "", _ATS, 99.0),
    (5, "Di", "Writer", "We're hiring an ML intern at Zeta Labs. Apply now.", "", [], None),
    (6, "Ed", "", "Nothing here", "", [], 1.0),
    (7, "Fay", "Writer", _HIRE, "", _ATS, 4.0),
]


@case(expected("seq BIGINT, target VARCHAR", [(1, "Acme"), (2, "Acme"), (3, "Acme"), (3, "Zeta Labs"), (4, "Acme"), (5, "Zeta Labs"), (7, "Acme")]))
def fixture_mention_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mention_join(_posts(spark, _WALK), "seq", haystack(), _frame(spark, "target string", [("Acme",), ("Zeta Labs",), ("Nobody Inc",), ("東京",)]))


@case(expected("seq BIGINT, target VARCHAR, stage VARCHAR", [(1, "Acme", "kept"), (3, "Acme", "prefilter"), (3, "Zeta Labs", "prefilter"), (4, "Acme", "too_old"), (5, "Zeta Labs", "kept"), (7, "Acme", "over_limit")]))
def fixture_company_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _frame(spark, "target string", [("Acme",), ("Zeta Labs",)])
    return company_walk(_posts(spark, _WALK), targets, keep_undated=True, limit=1).select("seq", "target", "stage")


@case(expected("seq BIGINT, stage VARCHAR", [(1, "kept"), (3, "not_hiring"), (4, "too_old"), (5, "undated"), (6, "not_hiring"), (7, "kept")]))
def fixture_keyword_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_posts(_posts(spark, _WALK)).select("seq", "stage")


_GATED = [(1, "kept"), (2, "gate:candidate_seeking"), (3, "gate:blocked_profile"), (4, "gate:invalid_json"), (5, "gate:not_hirer")]


@case(expected("seq BIGINT, stage VARCHAR, kept BOOLEAN", [(n, s, s == "kept") for n, s in _GATED]))
def fixture_semantic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "A", "", "Apply here"), (2, "B", "", "I'm looking for a role"), (3, "Bad", "", "Apply here"), (4, "C", "", "Apply here"), (5, "D", "", "text")]
    posts = _posts(spark, [(n, p, h, t, f"u{n}", [], 1.0) for n, p, h, t in rows]).withColumns({"company": F.lit("Acme"), "poster_employer": F.lit(""), "author_affiliation_matches_target": F.lit(False)})
    history = conform(_frame(spark, "company string, poster string, kept boolean", [("Acme", "Bad", False)] * 2), HISTORY)
    batches = gate_batches(posts, history)
    flags = {k: F.lit(k in ("role_named", "is_offer_not_request")) for k in ("author_is_hirer", "is_offer_not_request", "cta_is_application", "role_named")}
    verdicts = batches.where("seq <> 4").select("company", "batch", "id").withColumns(flags | {"intent": F.lit("company_hiring"), "reason": F.lit("r")})
    gated = semantic_gate(posts, verdicts, history)
    kept = history_rows(gated, "2024-01-31T00:00:00").select("post_url", "kept")
    return gated.join(kept, "post_url").select("seq", "stage", "kept")


@case(expected("seq BIGINT, rank INTEGER, why_matched VARCHAR", [(2, 0, "gate:keep,source:company; poster:B (ok)"), (1, 3, "gate:keep,source:creator; poster:A; followers:12k")]))
def fixture_relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, [(1, "A", "12k followers", "t", "", [], 1.0), (2, "B", "", "t", "", [], 1.0), (3, "C", "", "t", "", [], 1.0), (4, "D", "", "t", "", [], 1.0)])
    verdicts = _frame(spark, "seq long, keep boolean, reason string, source_type string", [(1, True, "", "creator"), (2, True, "ok", "company"), (3, True, "", "aggregator")])
    return relevance_gate(posts, verdicts).select("seq", "rank", "why_matched")


_LINKED = f"{_SITE}/feed/update/urn:li:activity:7489706814855344128/"


@case(expected("seq BIGINT, url_reason VARCHAR, post_url VARCHAR", [(1, "exact", _LINKED), (2, "anchor", _LINKED), (3, "cache", "https://cached.example/"), (4, "no_permalink", ""), (5, "budget", "")]))
def fixture_permalink_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, [(1, "A", "", "t", _LINKED, [], 1.0), (2, "B", "", "t", "", ["/in/b/", "/feed/update/urn%3Ali%3Aactivity%3A7489706814855344128/"], 1.0), (3, "C", "", "Hello", "", [], 1.0), (4, "D", "", "t", f"{_SITE}/search/results/content/", [], 1.0), (5, "E", "", "t", "", [], 1.0)])
    cache = _frame(spark, "cache_key string, permalink string", [("c|hello", "https://cached.example/")])
    return fill_permalinks(posts, cache, budget=3).select("seq", "url_reason", "post_url")


@case(expected("seq BIGINT, company_class VARCHAR, startup BOOLEAN", [(1, "funded_startup", True), (2, "", False)]))
def fixture_company_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, [(1, "ACME ", "", "t", "", [], 1.0), (2, "B", "", "t", "", [], 1.0)])
    classes = _frame(spark, "name string, category string, confidence double", [("Acme", "funded_startup", 0.9)])
    return label_companies(posts, classes).select("seq", "company_class", is_startup(F.col("company_class")).alias("startup"))
