"""Feedback history: keyed upserts, labels, profiles of posters, labelled examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.entities import fold_company
from siftwell.functions.text import text_of
from siftwell.operators.funnel import limit_per_key

EXAMPLES = 4


def history_key(url: Column, company: Column, poster: Column, gate_reason: Column) -> Column:
    """The permalink, else company, poster and reason."""
    low = lambda c: F.lower(F.trim(text_of(c)))
    return F.coalesce(F.nullif(F.trim(text_of(url)), F.lit("")), F.concat_ws("|", low(company), low(poster), low(gate_reason)))


def upsert(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, with ``first_seq`` to keep first-seen order.

    Both come from one partial aggregate; a key with very many rows is no hot task.
    """
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("_r"), F.min(seq).alias("first_seq"))
    return newest.select("_r.*", "first_seq")


def apply_labels(history: DataFrame, labels: DataFrame, as_of: str) -> DataFrame:
    """Attach good or bad labels by permalink; the last label of a permalink (by ``seq``) counts."""
    good = labels.select(F.trim("post_url").alias("post_url"), F.lower("label").alias("label"), "seq").where(F.col("label").isin("good", "bad") & (F.col("post_url") != ""))
    one = good.groupBy("post_url").agg(F.max_by("label", "seq").alias("_label"))
    joined = history.withColumn("_u", F.trim("post_url")).join(one.withColumnRenamed("post_url", "_u"), "_u", "left")
    return joined.withColumns({"user_label": F.coalesce("_label", "user_label"), "timestamp": F.when(F.col("_label").isNotNull(), F.lit(as_of)).otherwise(F.col("timestamp"))}).select(*history.columns)


def poster_profiles(history: DataFrame) -> DataFrame:
    """``company_key, poster, positives, negatives, trusted, blocked``: two good or bad rows, or one label; blocked wins."""
    label = F.lower(F.trim(text_of("user_label")))
    rows = history.select(fold_company(text_of("company")).alias("company_key"), F.lower(F.trim(text_of("poster"))).alias("poster"), F.coalesce("kept", F.lit(False)).alias("kept"), label.alias("label")).where("poster <> ''")
    grouped = rows.groupBy("company_key", "poster").agg(
        F.count_if(F.col("kept") | (F.col("label") == "good")).alias("positives"),
        F.count_if(~F.col("kept") | (F.col("label") == "bad")).alias("negatives"),
        F.bool_or(F.col("label") == "good").alias("_good"),
        F.bool_or(F.col("label") == "bad").alias("_bad"),
    )
    blocked = (F.col("negatives") >= 2) | F.col("_bad")
    return grouped.select("company_key", "poster", "positives", "negatives", (((F.col("positives") >= 2) | F.col("_good")) & ~blocked).alias("trusted"), blocked.alias("blocked"))


def opening_domains(history: DataFrame) -> DataFrame:
    """Link domains of positive rows by company, sorted."""
    positive = F.coalesce("kept", F.lit(False)) | (F.lower(F.trim(text_of("user_label"))) == "good")
    rows = history.where(positive).select(fold_company(text_of("company")).alias("company_key"), F.explode("link_domains").alias("d")).where("d <> ''")
    return rows.select("company_key", F.lower("d").alias("d")).distinct().groupBy("company_key").agg(F.array_sort(F.collect_list("d")).alias("domains"))


def labelled_examples(history: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The newest labelled rows of each company."""
    rows = history.withColumn("company_key", fold_company(text_of("company"))).where(F.lower(F.trim(text_of("user_label"))).isin("good", "bad"))
    return limit_per_key(rows, ["company_key"], [F.desc("timestamp"), F.col("post_url")], most)


def screen_posters(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Posts with ``poster_blocked`` and ``profile_prior``: an equi-join on company and poster."""
    keyed = posts.withColumns({"company_key": fold_company(text_of("company")), "_p": F.lower(F.trim(text_of("poster")))})
    facts = profiles.select("company_key", F.col("poster").alias("_p"), "trusted", "blocked")
    out = keyed.join(facts, ["company_key", "_p"], "left")
    return out.withColumns({"poster_blocked": F.coalesce("blocked", F.lit(False)), "profile_prior": F.when(F.col("trusted"), "trusted_poster").otherwise("")}).drop("_p", "company_key", "trusted", "blocked")


def few_shots(examples: DataFrame) -> DataFrame:
    """One prompt text a company from its labelled examples."""
    line = F.concat(F.lit("- "), F.upper("user_label"), F.lit(": poster='"), text_of("poster"), F.lit("'; intent='"), text_of("intent"), F.lit("'; reason='"), text_of("gate_reason"), F.lit("'"))
    ordered = examples.groupBy("company_key").agg(F.array_sort(F.collect_list(F.struct(F.col("timestamp"), line.alias("line")))).alias("l"))
    return ordered.select("company_key", F.concat(F.lit("User-labelled examples for this target company:\n"), F.array_join(F.transform(F.reverse("l"), lambda x: x["line"]), "\n")).alias("few_shots"))
