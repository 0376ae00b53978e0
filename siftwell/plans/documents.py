"""Queries over ``documents`` (and ``labels``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import folded_case, has_any_term, identity_key, prompt_head, search_tokens, sentences, snippet, text_of
from siftwell.operators.funnel import drop_map, first_stage, funnel, keep_first, tally, top_counts
from siftwell.operators.matching import Vocabulary, match_terms
from siftwell.operators.provenance import roundup_signals
from siftwell.plans.registry import query, table

#: The default vocabularies don't occur in invented prose; these terms do, in its four languages.
WORDS = dict(hiring=("with", "für", "avec", "por", "to the", "de la"), role=("that", "nicht", "pour", "para", "a.i."), domain=("ai", "eau", "sch", "ción", "be the"))
ALL, LOOSE = Vocabulary(**WORDS), Vocabulary(**WORDS, mode="loose")


def _hits_sql(group: str) -> str:
    """The list of hits in DuckDB, whose patterns have no look-around."""

    def one(t: str) -> str:
        body = t.replace(".", "\\.").replace(" ", "\\s+")
        return f"CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){body}($|[^\\p{{L}}\\p{{N}}_])') THEN '{t}' END"

    return f"list_filter([{', '.join(one(t) for t in WORDS[group])}], lambda x: x IS NOT NULL)"


_GROUPS = ", ".join(f"{_hits_sql(g)} AS {g}" for g in WORDS)
_HITS = f"WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents), h AS (SELECT *, {_GROUPS} FROM d)"
_ALL_SQL = "len(hiring) > 0 AND len(role) > 0 AND len(domain) > 0"
_LOOSE_SQL = "len(hiring) > 0 AND (len(role) > 0 OR len(domain) > 0)"
_STAGE_SQL = "CASE WHEN length(text) < 200 THEN 'too_short' WHEN len(hiring) = 0 THEN 'no_hiring' WHEN len(role) = 0 THEN 'no_role' WHEN len(domain) = 0 THEN 'no_domain' ELSE 'kept' END"
STAGES = ("too_short", "no_hiring", "no_role", "no_domain", "kept")


def _reason_sql(g: str) -> str:
    return f"'{g}:' || CASE WHEN len({g}) = 0 THEN 'none' ELSE array_to_string({g}[1:3], ', ') END"


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text_of("text").alias("text"))
    own = docs.withColumn("low", folded_case(F.col("text")))
    none = lambda g: ~has_any_term(F.col("text"), WORDS[g], F.col("low"))
    return own.withColumn("stage", first_stage([("too_short", F.char_length("text") < 200), ("no_hiring", none("hiring")), ("no_role", none("role")), ("no_domain", none("domain"))])).drop("low")


@query(f"{_HITS} SELECT doc_id, {_ALL_SQL} AS matched FROM h")
def term_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_terms(table(spark, sf_dir, "documents"), "text", ALL).select("doc_id", "matched")


@query(f"{_HITS} SELECT doc_id, {_LOOSE_SQL} AS matched FROM h")
def term_match_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_terms(table(spark, sf_dir, "documents"), "text", LOOSE).select("doc_id", "matched")


@query(f"{_HITS} SELECT doc_id, CASE WHEN text = '' THEN 'no post text' ELSE {_reason_sql('hiring')} || '; ' || {_reason_sql('role')} || '; ' || {_reason_sql('domain')} END AS why FROM h")
def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_terms(table(spark, sf_dir, "documents"), "text", ALL).select("doc_id", F.array_join("reasons", "; ").alias("why"))


@query(f"{_HITS} SELECT lang, count(*) AS seen, " + ", ".join(f"count(*) FILTER ({_STAGE_SQL} = '{s}') AS {s}" for s in STAGES) + " FROM h GROUP BY lang")
def funnel_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel(_staged(spark, sf_dir), ["lang"], STAGES)


@query(f"{_HITS} SELECT source, {_STAGE_SQL} AS stage, count(*) AS n FROM h GROUP BY ALL")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(_staged(spark, sf_dir), ["source"])


@query(f"{_HITS}, s AS (SELECT source, {_STAGE_SQL} AS stage, count(*) AS n FROM h GROUP BY ALL) SELECT source, string_agg(stage || '=' || n, ',' ORDER BY stage) AS drops FROM s WHERE stage <> 'kept' GROUP BY source")
def drop_map_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _staged(spark, sf_dir).withColumn("label", F.when(F.col("stage") == "kept", "").otherwise(F.concat("stage", F.lit(" (detail)"))))
    entries = F.transform(F.array_sort(F.map_entries("drops")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return drop_map(rows, "source", "label").select("source", F.array_join(entries, ",").alias("drops"))


_FOLD_SQL = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"


@query(f"SELECT doc_id, identity FROM (SELECT doc_id, 'text:' || lower(trim(source)) || ':' || substr(sha256({_FOLD_SQL}), 1, 16) AS identity, row_number() OVER (PARTITION BY 'text:' || lower(trim(source)) || ':' || sha256({_FOLD_SQL})[1:16] ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def text_identity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", identity_key(F.lit(""), F.col("source"), text_of("text")).alias("identity"))
    return keep_first(docs, ["identity"], ["doc_id"]).select("doc_id", "identity")


@query(r"SELECT doc_id, CASE WHEN length(t) > 240 THEN rtrim(substr(t, 1, 239)) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)")
def snippet_240(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", snippet(text_of("text")).alias("snippet"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left").select("doc_id", "source", "quality", "toxic", F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("SELECT doc_id, length(substr(coalesce(text, ''), 1, 30000)) AS kept_chars, sha256(substr(coalesce(text, ''), 1, 30000)) AS head_sha256 FROM documents")
def doc_prompt_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = prompt_head(text_of("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(head).alias("kept_chars"), F.sha2(head, 256).alias("head_sha256"))


@query(r"SELECT doc_id, greatest(len(s), 1) AS n_sentences, CASE WHEN len(s) = 0 THEN length(t) ELSE list_max(list_transform(s, lambda x: length(x))) END AS longest FROM (SELECT doc_id, t, list_filter(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x) <> '') AS s FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", sentences(text_of("text")).alias("s"))
    return docs.select("doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", F.char_length)).alias("longest"))


@query(r"WITH w AS (SELECT doc_id, regexp_extract_all(replace(coalesce(text, ''), '*', ' '), '[\p{L}\p{N}\p{M}_'']{3,}') AS ws FROM documents), k AS (SELECT doc_id, ws, list_filter(ws, lambda x: NOT list_contains(['the','and','for','are','you','your','our','with','this','that','hiring','looking','intern','internship','apply','join'], lower(x))) AS ks FROM w) SELECT doc_id, array_to_string(CASE WHEN len(ks) > 0 THEN ks[1:6] ELSE ws[1:6] END, ' ') AS tokens FROM k")
def search_token_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(search_tokens(text_of("text")), " ").alias("tokens"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_counts(table(spark, sf_dir, "documents"), "source", 5)


_ITEM_SQL = r"""regexp_matches(l, '(?i)^\s*(\d+[).]|[-•]|[1-9]\x{FE0F}\x{20E3})\s*.{0,90}(intern|opening|hiring|role)')"""


@query(
    rf"""WITH t AS (SELECT doc_id, replace(replace(regexp_replace(coalesce(text, ''), '(^|\s)#\w+', '\1', 'g'), '. ', chr(10) || '- '), 'and', 'role') AS t FROM documents),
    l AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(t, '((?:^|\n)\s*(?:\d+[).]|[-•]))\s+', '\1 ', 'g'), chr(10)), lambda l: regexp_matches(l, '\S')), lambda l: {_ITEM_SQL}) AS items FROM t)
    SELECT doc_id, len(list_filter(range(1, len(items)), lambda i: items[i] AND items[i + 1])) > 0 AS listed FROM l"""
)
def role_lists_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents, their sentences taken as bullets and a frequent word as the role, list two openings on end."""
    body = F.replace(F.replace(text_of("text"), F.lit(". "), F.lit("\n- ")), F.lit("and"), F.lit("role"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_contains(roundup_signals(body), "multi-role-dump").alias("listed"))
