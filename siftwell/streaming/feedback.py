"""The feedback history as keyed state: rows and labels arrive as a stream, each key holds its last row.

Events are ``key, seq, kind, row``: ``row`` replaces what the key holds, ``label`` (``good`` or
``bad`` in ``row``) changes the label of what it holds and is void where there is nothing yet.  A
later row of a key starts without the label of the one before; a label that arrives in an earlier
batch than its row is void.  ``seq`` orders the events of a key.

State a key is its last row with its place, its first ``seq`` and the label with its place (so that
late events don't undo newer ones), whatever the history's length, so a
batch costs its own events and no rewrite of the history.  Before they are shuffled the events of a
key within an Arrow batch are folded to one, so a key with a third of all events is no hot task.
Each change is given as a retraction (``sign`` -1) of the row before and the new row (``sign`` 1):
what is summed over the changes, such as the profiles of posters, equals what a whole history gives.

The streaming form needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftwell.functions.entities import fold_company
from siftwell.functions.text import text_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "key string, seq long, kind string, row string"
#: Events of a key as one: the last row with its place, the first row's place, the last label with its place.
_FOLDED = "key string, first long, at long, row string, label_at long, label string"
_STATE = "first long, at long, row string, label_at long, label string"
CHANGE = "key string, first_seq long, row string, label string, sign int"


def _pick(places: pd.Series, values: pd.Series, texts: pd.Series) -> tuple[int | None, Any]:
    """The greatest place and its value; of equal places the greatest text."""
    known = places.notna()
    if not known.any():
        return None, None
    best = int(places[known].max())
    return best, max(zip(texts[known & (places == best)].fillna(""), values[known & (places == best)], strict=True))[1]


def _fold(key: str, rows: pd.DataFrame) -> dict[str, Any]:
    at, row = _pick(rows["at"], rows["row"], rows["row"])
    label_at, label = _pick(rows["label_at"], rows["label"], rows["label"])
    first = rows["first"].min()
    return {"key": key, "first": None if pd.isna(first) else int(first), "at": at, "row": row, "label_at": label_at, "label": label}


def _typed(rows: list[dict[str, Any]], names: list[str]) -> pd.DataFrame:
    """Numbers with blanks as nullable integers."""
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({n: "Int64" for n in names if n in ("first", "at", "label_at", "first_seq", "sign")})


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = _FOLDED.replace(" string", "").replace(" long", "").split(", ")
    for rows in batches:
        yield _typed([_fold(key, own) for key, own in rows.groupby("key", sort=False)], names)


def _events(events: DataFrame) -> DataFrame:
    """Each event as a fold of one; other kinds, labels that are none, null keys and places take no part."""
    label = F.when((F.col("kind") == "label") & F.lower("row").isin("good", "bad"), F.lower("row"))
    is_row = F.col("kind") == "row"
    one = events.select("key", F.when(is_row, F.col("seq")).alias("first"), F.when(is_row, F.col("seq")).alias("at"), F.when(is_row, F.col("row")).alias("row"), F.when(label.isNotNull(), F.col("seq")).alias("label_at"), label.alias("label"))
    return one.where("key is not null and coalesce(at, label_at) is not null")


class _History(StatefulProcessor):
    """One value a key; events older than the row that is held don't replace it."""

    def __init__(self, keep: timedelta | None) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _STATE, int(self.keep.total_seconds() * 1000) if self.keep else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        folded = _fold(key[0], pd.DataFrame([_fold(key[0], part) for part in rows]))
        old = self.held.get() if self.held.exists() else None
        first, at, row, label_at, label = old if old else (None,) * 5
        if folded["at"] is not None:
            first = folded["first"] if first is None else min(first, folded["first"])
            if at is None or folded["at"] >= at:
                at, row = folded["at"], folded["row"]
        if folded["label_at"] is not None and (label_at is None or folded["label_at"] >= label_at):
            label_at, label = folded["label_at"], folded["label"]
        if at is not None and label_at is not None and label_at <= at:
            label_at, label = None, None
        new = (first, at, row, label_at, label)
        changes = []
        if at is not None and (not old or tuple(old) != new):
            self.held.update(new)
            if old:
                changes.append({"key": key[0], "first_seq": old[0], "row": old[2], "label": old[4], "sign": -1})
            changes.append({"key": key[0], "first_seq": first, "row": row, "label": label, "sign": 1})
        yield _typed(changes, ["key", "first_seq", "row", "label", "sign"])

    def close(self) -> None:
        pass


def history_changes(events: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """``key, first_seq, row, label, sign`` of a stream (or a table) of events; with ``keep``, keys that rest longer are forgotten."""
    folded = _events(events).mapInPandas(_partial, _FOLDED)
    mode = "processingTime" if keep else "none"
    kind = T._parse_datatype_string(CHANGE)
    return folded.groupBy("key").transformWithStateInPandas(_History(keep), kind, "Update", mode)


def history_of(events: DataFrame) -> DataFrame:
    """The same fold of a whole table in one aggregate: ``key, first_seq, row, label``."""
    last = lambda value, place: F.max_by(value, F.struct(place, value))
    folded = _events(events).groupBy("key").agg(F.min("first").alias("first_seq"), F.max("at").alias("at"), last("row", "at").alias("row"), F.max("label_at").alias("label_at"), last("label", "label_at").alias("label"))
    return folded.where("at is not null").select("key", "first_seq", "row", F.when(F.col("label_at") > F.col("at"), F.col("label")).alias("label"))


def history_now(changes: DataFrame) -> DataFrame:
    """What the changes add up to: the rows that are held."""
    same = changes.groupBy("key", "first_seq", "row", "label").agg(F.sum("sign").alias("n"))
    return same.where("n > 0").drop("n")


def profiles_of(changes: DataFrame) -> DataFrame:
    """``company_key, poster, positives, negatives, trusted, blocked`` from changes, as sums of signs.

    ``row`` is JSON with ``company``, ``poster`` and ``kept``; two good or bad rows or one label decide, and blocked wins.
    """
    row = F.from_json("row", "company string, poster string, kept boolean")
    own = changes.withColumn("r", row).select(fold_company(text_of("r.company")).alias("company_key"), F.lower(F.trim(text_of("r.poster"))).alias("poster"), F.coalesce("r.kept", F.lit(False)).alias("kept"), F.coalesce("label", F.lit("")).alias("label"), "sign").where("poster <> ''")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("sign")).otherwise(0))

    sums = own.groupBy("company_key", "poster").agg(
        total(F.col("kept") | (F.col("label") == "good")).alias("positives"), total(~F.col("kept") | (F.col("label") == "bad")).alias("negatives"),
        total(F.col("label") == "good").alias("_good"), total(F.col("label") == "bad").alias("_bad"), F.sum("sign").alias("_rows"),
    )
    blocked = (F.col("negatives") >= 2) | (F.col("_bad") > 0)
    return sums.where("_rows > 0").select("company_key", "poster", "positives", "negatives", (((F.col("positives") >= 2) | (F.col("_good") > 0)) & ~blocked).alias("trusted"), blocked.alias("blocked"))
