"""Company classes from a model, kept in a cache table: what is missing, in batches; what came back; an idempotent merge.

The model itself is not called here: a batch goes out as names, a reply comes back as text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.ranks import numbered

#: Names in a request.
BATCH = 25
#: The classes and the confidences that a reply may name.
CATEGORIES = ("funded_startup", "big_tech_or_enterprise", "agency_or_consultancy", "education_or_training", "unknown")
CONFIDENCES = ("high", "medium", "low")
_ROW = "struct<company:string,category:string,confidence:string>"


def _key(name: Column) -> Column:
    return F.lower(F.trim(name))


def pending(names: DataFrame, cache: DataFrame, name: str = "name", seq: str = "seq", size: int = BATCH) -> DataFrame:
    """``batch, id, name, name_key``: names that the cache lacks, once each ignoring case, in batches in the order of their first occurrence.

    A second run over the same names asks only for what the first one has not brought.
    Blank and null names are no names.  The first spelling is a partial aggregate, the
    cache an anti join, and batches are numbered in slices, so no task holds a whole table.
    """
    own = names.where(F.trim(F.coalesce(name, F.lit(""))) != "").groupBy(_key(F.col(name)).alias("name_key")).agg(F.min_by(F.trim(name), seq).alias("name"), F.min(seq).alias("_seq"))
    missing = own.join(cache.select("name_key").distinct(), "name_key", "left_anti")
    n = F.col("_number")
    return numbered(missing, ["_seq", "name_key"], "_number").select(F.floor(n / size).cast("long").alias("batch"), (n % size).cast("int").alias("id"), "name", "name_key")


def read_replies(replies: DataFrame, asked: DataFrame, *, categories: Sequence[str] = CATEGORIES, source: str = "model-guess") -> DataFrame:
    """``name_key, name, category, confidence, source`` of ``replies(batch, reply)`` to the batches ``asked``.

    A reply is a JSON object with ``results`` or a list; an unreadable one says nothing.
    Classes and confidences that aren't known are ``unknown`` and ``low``, as is every name
    asked for that no reply mentions.  Names that were not asked for are kept as they are
    spelled; of several rows for a name the last of the last batch counts.
    """
    listed = F.from_json("reply", f"array<{_ROW}>")
    held = F.from_json("reply", f"struct<results:array<{_ROW}>>")["results"]
    rows = replies.select("batch", F.posexplode(F.when(F.trim("reply").startswith("["), listed).otherwise(held)).alias("_at", "r")).where(F.trim(F.coalesce("r.company", F.lit(""))) != "")
    known = lambda c, values, other: F.when(_key(c).isin(*values), _key(c)).otherwise(other)
    told = rows.select(_key(F.col("r.company")).alias("name_key"), F.trim("r.company").alias("_spelled"), known(F.col("r.category"), categories, "unknown").alias("category"), known(F.col("r.confidence"), CONFIDENCES, "low").alias("confidence"), "batch", "_at")
    last = told.groupBy("name_key").agg(F.max_by(F.struct("_spelled", "category", "confidence"), F.struct("batch", "_at")).alias("_r"))
    both = last.join(asked.select("name_key", "name"), "name_key", "full")
    return both.select("name_key", F.coalesce("name", "_r._spelled").alias("name"), F.coalesce("_r.category", F.lit("unknown")).alias("category"), F.coalesce("_r.confidence", F.lit("low")).alias("confidence"), F.lit(source).alias("source"))


def merged(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache with what was found; a name that is in both keeps its cached class, so merging again changes nothing."""
    columns = ["name_key", "name", "category", "confidence", "source"]
    return cache.select(*columns).unionByName(found.select(*columns).join(cache.select("name_key"), "name_key", "left_anti"))
