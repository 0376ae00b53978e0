"""Model verdicts: parsing replies, the keep rule, and joining verdicts to records.

No model is called here.  A verdict table (or a function that makes one from batches)
is the interface.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.text import snippet, strip_fences, text_of
from siftwell.operators.provenance import is_roundup

INTENTS = ("company_hiring", "candidate_seeking", "project_showcase", "offer_celebration", "referral_or_roundup", "mention_only", "other")
SOURCE_TYPES = ("company", "employee", "recruiter", "creator", "aggregator", "spam")
APPLY_CATEGORIES = ("ats_or_careers", "company_domain")
OTHER_CATEGORIES = ("poster_portfolio_or_github", "social_or_chat", "link_hub_or_junk")
FLAGS = ("author_is_hirer", "is_offer_not_request", "cta_is_application", "role_named")
_EXPLICIT = r"(?iU)\b(?:apply\s+(?:here|now|via|using)|application\s+(?:form|link)|(?:share|send)\s+(?:your\s+)?(?:resume|cv)\s+to\s+\w+)"
#: What someone who looks for work writes.
SEEKING = (
    r"(?iU)\b(?:i['’]?m|i am|we are)\s+(?:actively\s+)?looking\s+for\b|\bopen\s+to\s+(?:work|opportunities|internships?)\b"
    r"|\bplease\s+(?:refer|refer me)\b|\b(?:seeking|looking for)\s+(?:an?\s+)?(?:internship|intern\s+role|opportunity)\b"
)


def is_seeking(*texts: Column) -> Column:
    """Candidate-seeking copy; a cheap test before any model is asked."""
    return F.concat_ws("\n", *texts).rlike(SEEKING)


def _rows(reply: Column, list_too: bool) -> Column:
    """The result rows of a reply as variants; null where it is not valid."""
    whole = F.try_parse_json(strip_fences(reply))
    rows = F.try_variant_get(whole, "$.results", "array<variant>")
    return F.coalesce(rows, F.try_variant_get(whole, "$", "array<variant>")) if list_too else rows


def _row_id(row: Column) -> Column:
    """Integers, and text that is one; fractions are truncated as they are read."""
    raw = F.try_variant_get(row, "$.id", "string")
    kind = F.schema_of_variant(F.try_variant_get(row, "$.id", "variant"))
    return F.when(kind == "STRING", F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("int"))).otherwise(raw.try_cast("double").cast("int"))


def _truthy(row: Column, key: str) -> Column:
    """JSON truthiness: ``"false"`` is true, empty and zero are not."""
    value = F.try_variant_get(row, f"$.{key}", "variant")
    text = F.try_variant_get(row, f"$.{key}", "string")
    kind = F.schema_of_variant(value)
    return F.coalesce(
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}"))
        .otherwise(text.try_cast("double") != 0),
        F.lit(False),
    )


def parse_tolerant(df: DataFrame, reply: str, size: str) -> DataFrame:
    """One row a verdict: ``id, keep, reason, source_type``; the last verdict on an id counts."""
    rows = df.select("*", F.posexplode(_rows(F.col(reply), True)).alias("_p", "_r"))
    own = rows.withColumn("id", _row_id(F.col("_r"))).where(F.col("id").between(0, F.col(size) - 1))
    has = F.try_variant_get("_r", "$.keep", "variant").isNotNull()
    kind = F.lower(F.trim(F.coalesce(F.try_variant_get("_r", "$.source_type", "string"), F.lit(""))))
    kind = F.when(kind == "farmer", "spam").when(kind.isin(*SOURCE_TYPES), kind).otherwise("")
    made = own.withColumn("keep", F.when(has, _truthy(F.col("_r"), "keep")).otherwise(_truthy(F.col("_r"), "hiring_now")))
    made = made.withColumn("source_type", F.when(kind != "", kind).when(~F.col("keep"), "spam").when(_truthy(F.col("_r"), "is_company_role"), "company").otherwise("employee"))
    made = made.withColumn("reason", F.trim(F.coalesce(F.try_variant_get("_r", "$.reason", "string"), F.lit(""))))
    return _last(made, df.columns, ["id", "keep", "reason", "source_type"])


def parse_strict(df: DataFrame, reply: str, size: str) -> DataFrame:
    """One row a verdict that is complete: real booleans, a known intent, an id within the batch."""
    rows = df.select("*", F.posexplode(_rows(F.col(reply), False)).alias("_p", "_r"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_r", f"$.{k}", "variant"))
    own = rows.withColumns({"id": _row_id(F.col("_r")), "intent": F.lower(F.trim(F.try_variant_get("_r", "$.intent", "string"))), "reason": F.trim(F.try_variant_get("_r", "$.reason", "string"))})
    real = F.lit(True)
    for k in FLAGS:
        real = real & F.coalesce(kind(k) == "BOOLEAN", F.lit(False))
    own = own.where(real & F.col("id").between(0, F.col(size) - 1) & F.col("intent").isin(*INTENTS) & F.col("reason").isNotNull())
    return _last(own.withColumns({k: F.try_variant_get("_r", f"$.{k}", "boolean") for k in FLAGS}), df.columns, ["id", *FLAGS, "intent", "reason"])


def _last(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    grouped = rows.groupBy(*keys, "id").agg(F.max_by(F.struct(*(v for v in values if v != "id")), "_p").alias("_v"))
    return grouped.select(*keys, "id", "_v.*")


@F.pandas_udf(T.StringType())
def salvage(replies: pd.Series) -> pd.Series:
    """The first JSON object inside a chatty reply, as text; empty if there is none."""
    decoder = json.JSONDecoder()

    def first(reply: str) -> str:
        at = (reply or "").find("{")
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(reply, at)
                return json.dumps(found, ensure_ascii=False)
            except ValueError:
                at = reply.find("{", at + 1)
        return ""

    return replies.map(first)


def has_application(text: Column, categories: Column, link_class: Column) -> Column:
    known = F.arrays_overlap(categories, F.array(*map(F.lit, APPLY_CATEGORIES)))
    return known | F.lower(link_class).isin(*APPLY_CATEGORIES, "careers") | text.rlike(_EXPLICIT)


def semantic_keep(v: dict[str, Column], text: Column, categories: Column, link_class: Column, employer: Column, affiliated: Column) -> Column:
    """Openings with a way to apply stay; those without need an author of the target's side.

    ``text`` is the record's own text once: a bullet that is merely repeated in a
    snippet doesn't make a roundup.
    """
    opening = (v["intent"] == "company_hiring") & v["role_named"]
    only_other = F.arrays_overlap(categories, F.array(*map(F.lit, OTHER_CATEGORIES)))
    by_author = v["author_is_hirer"] & v["is_offer_not_request"] & ((F.trim(employer) == "") | affiliated)
    return F.coalesce(opening & ~is_roundup(text) & (has_application(text, categories, link_class) | (~only_other & by_author)), F.lit(False))


def drop_reason(v: dict[str, Column], text: Column, categories: Column, link_class: Column, employer: Column, affiliated: Column) -> Column:
    """Why a judged record is dropped; the first reason that applies."""
    return (
        F.when(v["intent"] == "candidate_seeking", "gate:candidate_seeking")
        .when(is_roundup(text), "gate:roundup")
        .when((F.trim(employer) != "") & ~affiliated & ~has_application(text, categories, link_class), "gate:employer_mismatch")
        .when(F.arrays_overlap(categories, F.array(*map(F.lit, OTHER_CATEGORIES))), "gate:no_application_cta")
        .when(~v["author_is_hirer"], "gate:not_hirer")
        .otherwise("gate:rejected")
    )


def verdict_source_type(existing: Column, author_is_hirer: Column, affiliated: Column, headline: Column) -> Column:
    return (
        F.when(F.lower(existing).isin("company", "company_page"), "company_page")
        .when(F.lower(existing).isin("employee", "recruiter"), F.lower(existing))
        .when(author_is_hirer & affiliated & headline.rlike(r"(?iU)\b(?:recruiter|talent|sourcer)\b"), "recruiter")
        .when(author_is_hirer & affiliated, "employee")
        .otherwise("third_party_with_apply_link")
    )


def join_verdicts(batched: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records with their verdicts by batch and id; ``judged`` is false where one is missing (those are dropped)."""
    keys = [c for c in ("company", "batch", "id") if c in batched.columns and c in verdicts.columns]
    return batched.join(verdicts.withColumn("judged", F.lit(True)), keys, "left").withColumn("judged", F.coalesce("judged", F.lit(False)))


def kept_rank(source_type: Column) -> Column:
    """Order of kept types: company, employee, recruiter, creator, then the rest."""
    return F.when(source_type == "company", 0).when(source_type == "employee", 1).when(source_type == "recruiter", 2).when(source_type == "creator", 3).otherwise(9)


def quoted_text(value: Column) -> Column:
    """Text in quotes as a prompt shows it: double ones where only single ones stand inside; breaks, tabs, backslashes escaped."""
    own = F.replace(text_of(value), F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        own = F.replace(own, F.lit(char), F.lit(shown))
    double = own.contains("'") & ~own.contains('"')
    return F.when(double, F.concat(F.lit('"'), own, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(own, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _quoted_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), quoted_text), ", "), F.lit("]"))


def post_block(df: DataFrame, index: str = "id") -> Column:
    """The text that describes one record to a model; columns that ``df`` lacks are blank.

    Links are the first six, the job link before them where it isn't one; the text is cut at 600 characters.
    """
    have = set(df.columns)
    t = lambda c: text_of(c) if c in have else F.lit("")
    listed = lambda c: F.coalesce(F.col(c) if c in have else F.lit(None), F.array()).cast("array<string>")
    or_else = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    links = F.array_join(F.filter(F.slice(listed("outbound_links"), 1, 6), lambda u: u != ""), ", ")
    with_job = F.when((t("job_link") != "") & ~F.contains(links, t("job_link")), F.regexp_replace(F.concat(t("job_link"), F.lit("; "), links), r"^[; ]+|[; ]+$", "")).otherwise(links)
    affiliated = F.when(F.coalesce(F.col("affiliated"), F.lit(False)), "True").otherwise("False") if "affiliated" in have else F.lit("False")
    counts = F.col("engagement") if "engagement" in have else F.lit(None).cast("map<string,bigint>")
    shown = F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string"))), ", ")
    fields = (("target_company", "company"), ("poster", "poster"), ("headline", "poster_headline"), ("role", "role"), ("link_class", "link_class"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.col(index).cast("string"), F.lit("] "), F.concat_ws(" ", *(F.concat(F.lit(f"{label}="), quoted_text(t(c))) for label, c in fields))),
        F.concat(F.lit("link_categories: "), _quoted_list(listed("link_categories"))),
        F.concat(F.lit("poster_employer: "), or_else(t("poster_employer"), "(unknown)"), F.lit("; author_affiliation_matches_target: "), affiliated),
        F.concat(F.lit("engagement: {"), F.coalesce(shown, F.lit("")), F.lit("}")),
        F.concat(F.lit("engagement_spam_signal: "), or_else(t("engagement_spam_signal"), "(none)")),
        F.concat(F.lit("profile_prior: "), or_else(t("profile_prior"), "(none)"), F.lit("; profile_opening_domains: "), _quoted_list(listed("profile_opening_domains"))),
        F.concat(F.lit("links: "), or_else(with_job, "(none)")),
        F.concat(F.lit("text: "), snippet(t("post_text"), 600)),
    )
