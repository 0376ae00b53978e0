"""Bounded samples of labelled documents for the two trained operators."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


#: Code points of the longest text that is sampled for training (scoring takes texts of any length).
LONGEST = 8_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held_out: int, per_class: int, longest: int = LONGEST) -> list[tuple[str, int]]:
    """``(text, label)`` of at most ``per_class`` documents of either class, none of the held-out fold.

    The sample is uniform (smallest hash of the id first), so it behaves alike at
    every size.  Its ids are at most ``2 * per_class``, the bound under which they are
    broadcast to pick the texts out of the documents; with at most ``longest`` code points
    a text that bounds what the driver gets.  Sampled documents whose text is longer are
    left out.  Ids labelled twice keep their largest label; of documents that share an id
    one is taken (the smallest text), null texts are empty; empty tables give an empty sample.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    parts = [one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.char_length("text") <= longest)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "y").collect()
    return without_copies([(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"]))])


def without_copies(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without near copies inside a class: a text goes if it shares a minimum of its
    word shingles, under one of three hashes, with an earlier one.

    A group of copies would otherwise make its accidental words look like evidence.
    """
    seen: set[tuple[int, int, int]] = set()
    kept = []
    for text, y in sample:
        words = text.lower().split()
        hashes = [zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4))]
        keys = {(y, n, min((h * m + n) & 0xFFFFFFFF for h in hashes)) for n, m in enumerate((1, 2654435761, 2246822519))}
        if not keys & seen:
            kept.append((text, y))
        seen |= keys
    return kept
