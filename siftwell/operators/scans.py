"""Paged scans cut at their first stop: pages in order, until one of them says that reading on is no use.

A scan is a key with numbered rounds (result pages, or rounds of scrolling).  Rules look at a
round by itself; runs of rounds that bring nothing new are found by meeting the rounds before,
so no key is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.urls import job_id
from siftwell.operators.funnel import first_stage, keep_first, limit_per_key

#: Rounds in a row without a new card that end a scroll.
PATIENCE = 2


def stagnant(rounds: DataFrame, keys: Sequence[str], number: str, loaded: str, patience: int = PATIENCE) -> DataFrame:
    """Add ``_stagnant``: whether this round and the ``patience - 1`` before it loaded as many cards as the round before each, and not none."""
    out = rounds.withColumn("_stagnant", F.col(loaded) > 0)
    for back in range(1, patience + 1):
        before = rounds.select(*keys, (F.col(number) + back).alias(number), F.col(loaded).alias(f"_back{back}"))
        out = out.join(before, [*keys, number], "left").withColumn("_stagnant", F.coalesce(F.col("_stagnant") & (F.col(f"_back{back}") == F.col(loaded)), F.lit(False)))
    return out.select(*rounds.columns, "_stagnant")


def cut_scan(rounds: DataFrame, keys: Sequence[str], number: str, *, before: Sequence[tuple[str, Column]] = (), after: Sequence[tuple[str, Column]] = (), loaded: str | None = None, patience: int = PATIENCE, most_rounds: int | None = None) -> DataFrame:
    """The rounds of every scan up to its first stop, with ``stopped_by``: the reason, or ``end``.

    Rules in ``before`` (an empty page, a login wall) drop the round they hold for, rules in
    ``after`` (an age past the window) keep it; on one round the first rule named counts, those
    before first.  ``loaded`` names a count of cards that ends a scan which stagnates.
    Rounds are numbered from 0 without gaps and don't repeat within a key; null rules don't
    hold.  Null keys are no scan.  The first stop is a partial aggregate by key.
    """
    for k in keys:
        rounds = rounds.where(F.col(k).isNotNull())
    own = stagnant(rounds, keys, number, loaded, patience) if loaded else rounds.withColumn("_stagnant", F.lit(False))
    rules = [*before, *after, ("stagnant", F.col("_stagnant"))]
    if most_rounds is not None:
        rules.append(("rounds", F.col(number) >= most_rounds - 1))
    judged = own.withColumn("_reason", first_stage(rules, kept=""))
    stops = judged.where("_reason <> ''").groupBy(*keys).agg(F.min(F.struct(F.col(number).alias("n"), F.col("_reason").alias("r"))).alias("_stop"))
    dropped = F.col("_stop.r").isin(*(n for n, _ in before)) if before else F.lit(False)
    kept = judged.join(stops, list(keys), "left").where(F.col("_stop").isNull() | (F.col(number) < F.col("_stop.n")) | ((F.col(number) == F.col("_stop.n")) & ~dropped))
    return kept.select(*rounds.columns, F.coalesce("_stop.r", F.lit("end")).alias("stopped_by"))


def scan_listings(cards: DataFrame, rounds: DataFrame, keys: Sequence[str], number: str, position: str, *, most: int | None = None) -> DataFrame:
    """Listings (``title, company, location, link``) of the rounds that a cut scan keeps: the first of each job by round and position, ``most`` a scan.

    A job is named by the id in its link, else by the link, else by title, company and location.
    """
    read = cards.join(rounds.select(*keys, number), [*keys, number], "left_semi")
    read = read.withColumn("_job", F.coalesce(F.nullif(job_id(F.col("link")), F.lit("")), F.concat_ws("|", "title", "company", "location")))
    one = keep_first(read, [*keys, "_job"], [number, position])
    return (limit_per_key(one, list(keys), [F.col(number), F.col(position)], most) if most is not None else one).drop("_job")
