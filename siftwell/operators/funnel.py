"""Stage accounting: every row ends in exactly one stage, and the counts can be checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.ranks import numbered

#: Reasons of a model gate, the first that applies.
GATE_REASONS = ("gate:candidate_seeking", "gate:roundup", "gate:employer_mismatch", "gate:no_application_cta", "gate:not_hirer", "gate:rejected")


def first_stage(stages: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first stage whose condition holds, in the order given; null conditions don't hold."""
    out = None
    for name, drops in stages:
        hit = F.coalesce(drops, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(kept) if out is None else out.otherwise(kept)


def tally(df: DataFrame, keys: Sequence[str], stage: str = "stage") -> DataFrame:
    """Rows by key and stage: a partial aggregate before one exchange."""
    return df.groupBy(*keys, stage).agg(F.count(F.lit(1)).alias("n"))


def funnel(df: DataFrame, keys: Sequence[str], stages: Sequence[str], stage: str = "stage") -> DataFrame:
    """One row a key: ``seen`` and a column for each stage, counted in one pass."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), *(F.count_if(F.col(stage) == s).alias(s) for s in stages))


def drop_map(df: DataFrame, key: str, label: str) -> DataFrame:
    """``key, drops map<string,bigint>``; labels are shortened to what precedes the first bracket."""
    short = F.trim(F.regexp_replace(F.col(label), r"\(.*$", ""))
    counts = df.where(F.col(label) != "").groupBy(key, short.alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_l", "_n")))).alias("drops"))


def is_monotonic(seen: Column, passed: Column, sent: Column, kept: Column) -> Column:
    return (seen >= passed) & (passed >= sent) & (sent >= kept)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the first by ``order``, whose columns have to tell ties apart.

    The minimum of a struct is a partial aggregate, so a key with very many rows is
    reduced before it is shuffled, unlike a window over it.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*(F.col(c) for c in [*order, *rest])), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*").select(*df.columns)


def merge_variations(parts: Sequence[DataFrame], key: Sequence[str], order: str = "seq") -> DataFrame:
    """Union of several scans in which the first occurrence of a key stays; ``order`` ranks the scans' rows."""
    whole = None
    for n, part in enumerate(parts):
        ranked = part.withColumn("_scan", F.lit(n))
        whole = ranked if whole is None else whole.unionByName(ranked)
    return keep_first(whole, key, ["_scan", order]).drop("_scan")


def limit_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key; Spark prunes groups before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def batch_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Add ``batch`` and ``id``: consecutive runs of ``size`` rows within each key, also where a key has very many rows."""
    n = F.col("_number")
    return numbered(df, order, "_number", keys).withColumns({"batch": F.floor(n / size).cast("long"), "id": (n % size).cast("int")}).drop("_number")


def top_counts(df: DataFrame, column: str, most: int) -> DataFrame:
    """The most frequent values; ties in the order of the value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(most)
