"""Queries over suppliers, customers and parts in the place of companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.entities import SUFFIXES, allowlist_semi_join, fold_company, mentions
from siftwell.operators.search_terms import explode_variations, is_prose, structured_query
from siftwell.plans.registry import query, table
from siftwell.sources.files import company_list

_TAILS = ("", " Technologies India", ", Inc.", " AI Labs Pvt. Ltd.")
_NAME = "s_name || CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' Technologies India' WHEN 2 THEN ', Inc.' ELSE ' AI Labs Pvt. Ltd.' END"
_FOLD = r"regexp_replace(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), '^(\S+(?: \S+)*?)(?: (?:" + "|".join(SUFFIXES) + r"))+$', '\1')"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", tail).alias("name"))


@query(f"SELECT s_suppkey, {_FOLD.format(_NAME)} AS folded FROM supplier")
def company_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).select("s_suppkey", fold_company(F.col("name")).alias("folded"))


@query(f"WITH s AS (SELECT s_suppkey, {_FOLD.format(_NAME)} AS f FROM supplier) SELECT s_suppkey FROM s WHERE EXISTS (SELECT 1 FROM (SELECT {_FOLD.format('s_name')} AS e FROM supplier WHERE s_acctbal >= 0) x WHERE contains(' ' || f || ' ', ' ' || e || ' ') OR contains(' ' || e || ' ', ' ' || f || ' '))")
def allowlist_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in good standing are the allow-list."""
    allowed = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_name").alias("name"))
    return allowlist_semi_join(_suppliers(spark, sf_dir), "name", allowed).select("s_suppkey")


@query("SELECT s_suppkey, query_no - 1 AS query_no, '\"' || s_name || '\" ' || tail AS query FROM supplier, (SELECT unnest(['intern', '(intern OR internship) (hiring OR \"we''re hiring\" OR openings)', '(SDE OR backend OR software) (intern OR internship)', '(ML OR data OR \"machine learning\") (intern OR internship) hiring', 'intern hiring', '\"we''re hiring\" (intern OR internship)', '(intern OR internship) openings']) AS tail, generate_subscripts([1,2,3,4,5,6,7], 1) AS query_no)")
def query_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_variations(table(spark, sf_dir, "supplier"), "s_name").select("s_suppkey", F.col("query_no").cast("long").alias("query_no"), "query")


@query("SELECT s_suppkey, '\"' || s_name || '\" (data) (intern OR internship) (hiring OR \"we''re hiring\" OR openings)' AS query, false AS prose FROM supplier")
def structured_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = structured_query(F.col("s_name"), "data")
    return table(spark, sf_dir, "supplier").select("s_suppkey", q.alias("query"), is_prose(q).alias("prose"))


@query("SELECT s_suppkey, true AS named, false AS other FROM supplier")
def company_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("We at "), F.replace(F.col("s_name"), F.lit("#"), F.lit(" # ")), F.lit(" ship parts."))
    return _suppliers(spark, sf_dir).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("s_suppkey", mentions(text, F.col("name")).alias("named"), mentions(F.lit("We ship parts."), F.col("name")).alias("other"))


@query(f"SELECT min(s_suppkey) AS seq, arg_min(name, s_suppkey) AS name FROM (SELECT s_suppkey, trim(split_part({_NAME}, ',', 1)) AS name, {_FOLD.format('trim(split_part(' + _NAME + ', chr(44), 1))')} AS k FROM supplier) GROUP BY k")
def company_list_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _suppliers(spark, sf_dir).select(F.col("name").alias("value"), F.col("s_suppkey").alias("seq"))
    noise = lines.select(F.concat(F.lit("# "), F.col("value")).alias("value"), "seq").unionByName(lines.select(F.lit("  ").alias("value"), "seq"))
    return company_list(lines.unionByName(noise)).select("seq", "name")
