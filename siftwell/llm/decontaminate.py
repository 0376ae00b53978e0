"""Benchmark decontamination (operator 10): rare n-gram seeds, then Smith-Waterman.

Seeds are pairs of words that stand next to each other or with one word between them.
They are chosen so that no copy is missed: let an item have L words and a copy an
alignment score of ``least`` of the item's own, that is 2m - e >= 2 least L with m
matched words and e errors between them.  Of the m - 1 steps from one matched word to
the next at most e / 2 hold two errors or more, and a step with at most one error is a
seed in item and document.  So a copy holds at least ``ceil(least L) - 1`` seeds of the
item, within ``(3 - 2 least) L`` words, however it was edited.

Rare seeds go first: with the documents counted in which each seed stands (one pass
over the corpus), an item's most frequent seeds are left out for as long as ``SEEDS``
of the rest (or all that a copy must hold, if fewer) are sure to be in every copy.
Passages with that many rare seeds are counted in full, and what holds enough seeds
and words is aligned with the item by Smith-Waterman over words; the score, as a share
of the item's own, decides.  Items of one or two words match only whole.

The index of the items is sent to the executors, so it is built over blocks of about
``BLOCK`` item words; a larger benchmark takes more passes, never a larger index.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import in_small_batches, plainly_named
from siftwell.llm.packing import text_chunks

WORD = re.compile(r"\w+")
#: Item words indexed in one pass.
BLOCK = 250_000
#: Share of an item's own alignment score from which a document holds a copy.
LEAST = 0.5
#: Rare seeds that a passage needs before it is looked at in full.
SEEDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
_NONE = np.zeros(0, np.int64)


def split(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a sequence of word numbers (-1: a word of no item): their keys and first places, by place."""
    if len(ids) < 2:
        return _NONE, _NONE
    second = np.append(ids[1:], -1)
    third = np.append(ids[2:], [-1, -1])
    key = np.stack([(ids << 32) | second, (ids << 32) | third], axis=1)
    fine = np.stack([(ids >= 0) & (second >= 0), (ids >= 0) & (third >= 0)], axis=1)
    return key[fine], np.repeat(np.arange(len(ids)), 2).reshape(-1, 2)[fine]


@dataclass
class Items:
    """Benchmark items as word numbers."""

    words: dict[str, int]
    ids: list
    own: list[np.ndarray]


def number_items(items: list[tuple]) -> Items:
    words: dict[str, int] = {}
    own = [np.array([words.setdefault(w, len(words)) for w in split(text)], dtype=np.int64) for _, text in items]
    return Items(words, [i for i, _ in items], own)


@dataclass
class Index:
    """Rare seeds of some items: sorted keys, and per key its postings ``(item, place)``."""

    items: Items
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    enough: np.ndarray  # rare seeds that a copy of each item must hold
    need: np.ndarray  # seeds that it must hold
    span: np.ndarray  # words in which they stand
    short: dict[tuple[int, ...], list[int]]  # items of one or two words
    least: float


def build(items: Items, seen: dict[int, int], least: float = LEAST) -> Index:
    """``seen``: the number of documents that hold a seed, by key."""
    size = np.array([len(o) for o in items.own], dtype=np.int64)
    need = np.maximum(np.ceil(least * size - 1e-9).astype(np.int64) - 1, 1)
    span = np.ceil((3 - 2 * least) * size).astype(np.int64) + 1
    enough = np.minimum(need, SEEDS)
    key, item, place = [_NONE], [_NONE], [_NONE]
    short: dict[tuple[int, ...], list[int]] = {}
    for n, own in enumerate(items.own):
        if len(own) < 3:
            if len(own):
                short.setdefault(tuple(own.tolist()), []).append(n)
            continue
        k, at = pairs(own)
        # every copy holds ``need`` of these, so ``enough`` of those that are left
        common = np.array([seen.get(x, 0) for x in k.tolist()])
        left = np.sort(np.lexsort((at, common))[: len(k) - int(need[n] - enough[n])])
        key.append(k[left])
        place.append(at[left])
        item.append(np.full(len(left), n))
    k, n, at = (np.concatenate(x) for x in (key, item, place))
    order = np.argsort(k, kind="stable")
    keys, first = np.unique(k[order], return_index=True)
    return Index(items, keys, np.append(first, len(k)), n[order], at[order], enough, need, span, short, least)


def _coded(texts: list[str], words: dict[str, int]) -> Iterator[np.ndarray]:
    get = words.get
    for t in texts:
        own = split(t)
        yield np.fromiter((get(w, -1) for w in own), dtype=np.int64, count=len(own))


def _found(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``key`` are among the sorted ``keys``, and where."""
    if not len(keys) or not len(key):
        return _NONE, _NONE
    k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = np.flatnonzero(keys[k] == key)
    return hit, k[hit]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: its score and where it ends in ``passage`` (exclusive)."""
    n = len(passage)
    if not n or not len(item):
        return 0, 0
    slide = np.arange(n + 1) * -GAP
    above = np.zeros(n + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item.tolist():
        row = np.zeros(n + 1, dtype=np.int64)
        row[1:] = np.maximum(np.maximum(above[:-1] + np.where(passage == w, MATCH, MISMATCH), above[1:] + GAP), 0)
        # gaps along the row: the best earlier cell less what the way from it costs
        row = np.maximum.accumulate(row + slide) - slide
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        above = row
    return best, end


def _passages(ids: np.ndarray, key: np.ndarray, at: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """``(item, from, to)``: stretches that hold all copies of an item, by its rare seeds."""
    hit, k = _found(index.keys, key)
    if not len(hit):
        return
    many = index.first[k + 1] - index.first[k]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, pos = index.item[np.repeat(index.first[k], many) + nth], np.repeat(at[hit], many)
    order = np.lexsort((pos, item))
    item, pos = item[order], pos[order]
    last = np.arange(len(item)) + index.enough[item] - 1
    inside = last < len(item)
    last = np.where(inside, last, 0)
    opens = np.flatnonzero(inside & (item[last] == item) & (pos[last] - pos <= index.span[item]))
    if not len(opens):
        return
    item, low, high = item[opens], pos[opens] - index.span[item[opens]], pos[last[opens]] + index.span[item[opens]] + 2
    cut = np.flatnonzero((np.diff(item) != 0) | (low[1:] > high[:-1])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(item)], strict=True):
        yield int(item[a]), max(0, int(low[a])), min(len(ids), int(high[b - 1]))


def _enough_seeds(own: np.ndarray, passage: np.ndarray, need: int, span: int) -> bool:
    """Whether somewhere in the passage so many seeds of the item stand within so many words."""
    key, at = pairs(passage)
    at = at[np.isin(key, pairs(own)[0])]
    return len(at) >= need and bool((at[need - 1 :] - at[: len(at) - need + 1] <= span).any())


def _whole(own: np.ndarray, passage: np.ndarray) -> int:
    """Where the item stands word for word, -1 if nowhere."""
    if len(passage) < len(own):
        return -1
    at = np.flatnonzero(passage[: len(passage) - len(own) + 1] == own[0])
    for k in (0, len(own) // 2, len(own) - 1):
        at = at[passage[at + k] == own[k]]
    return next((k for k in at.tolist() if np.array_equal(passage[k : k + len(own)], own)), -1)


def leaks_of(ids: np.ndarray, index: Index) -> list[tuple]:
    """``(share, first word, last word, item_id)`` of every item that ``ids`` hold a copy of."""
    best: dict[int, tuple] = {}
    for n, a, b in _passages(ids, *pairs(ids), index):
        if best.get(n, (0.0,))[0] >= 1.0:
            continue
        own, passage = index.items.own[n], ids[a:b]
        if (k := _whole(own, passage)) >= 0:
            best[n] = (1.0, a + k, a + k + len(own) - 1)
            continue
        # each matched word is one of the item and one of the passage
        if min(np.isin(own, passage).sum(), np.isin(passage, own).sum()) < index.least * len(own) - 1e-9 or not _enough_seeds(own, passage, int(index.need[n]), int(index.span[n])):
            continue
        score, end = align(own, passage)
        share = score / (MATCH * len(own))
        if share >= index.least and share > best.get(n, (0.0,))[0]:
            _, back = align(own[::-1], passage[:end][::-1])
            best[n] = (share, a + end - back, a + end - 1)
    for own, numbers in index.short.items() if index.short else ():
        at = np.flatnonzero(ids == own[0])
        at = at if len(own) == 1 else at[np.append(ids, -1)[at + 1] == own[1]]
        if len(at):
            best.update((n, (1.0, int(at[0]), int(at[0]) + len(own) - 1)) for n in numbers)
    return [(*v, index.items.ids[n]) for n, v in best.items()]


def _texts(docs: DataFrame) -> DataFrame:
    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def item_blocks(items: DataFrame, block: int) -> Iterator[list[tuple]]:
    """The items dealt by a hash in blocks of about ``block`` words; one block at a time is collected."""
    usable = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    words = usable.agg(F.sum(F.size(F.split("text", r"(?U)\W+")))).first()[0] or 0
    blocks = max(1, math.ceil(words / block))
    for b in range(blocks if words else 0):
        yield sorted(((r["item_id"], r["text"]) for r in usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def seed_counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents of the whole corpus each seed of the items stands; as long as the block of items."""
    keys = np.unique(np.concatenate([_NONE, *(pairs(o)[0] for o in items.own)]))
    words = items.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            for _, texts in text_chunks(batch, "text"):
                for ids in _coded(texts, words):
                    _, k = _found(keys, pairs(ids)[0])
                    count[np.unique(k)] += 1
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(count[some])], names=["seed", "n"])

    counted = _texts(docs).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return {r["seed"]: r["n"] for r in counted.collect()}


def indexes(docs: DataFrame, items: DataFrame, least: float, block: int) -> Iterator[Index]:
    for part in item_blocks(items, block):
        numbered = number_items(part)
        yield build(numbered, seed_counts(docs, numbered), least)


def find_leaks(docs: DataFrame, items: DataFrame, *, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word`` for every document that holds a copy of an item.

    ``docs(doc_id, text)``, ``items(item_id, text)``; other columns are ignored.  Score:
    alignment score over the item's own, at least ``least``; the words (``\\w+``, lower
    case, from 0) bound the best aligned passage.  Items of one or two words match only
    whole, items without words match nothing, nor do null and empty texts; repeated rows
    repeat; either table empty gives an empty result.
    """
    kinds = "doc_id long, item_id long, score double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], kinds)
    for index in indexes(docs, items, least, block):
        out = out.unionByName(_texts(docs).mapInArrow(_matcher(index), kinds))
    return out


def _matcher(index: Index):
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column("doc_id")
            rows: list[tuple] = []
            for first, texts in text_chunks(batch, "text"):
                for k, ids in enumerate(_coded(texts, index.items.words)):
                    rows.extend((owners[first + k].as_py(), item_id, share, a, b) for share, a, b, item_id in leaks_of(ids, index))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return run


def without_leaks(docs: DataFrame, items: DataFrame, *, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold a copy of no item, all columns untouched: a filter, nothing is joined.

    Every row is judged by itself, whether it has a doc_id or not; an empty benchmark keeps all.
    """
    out = plainly_named(docs)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for index in indexes(docs, items, least, block):
        out = in_small_batches(out).mapInArrow(_filter(index), kinds)
    return out.toDF(*docs.columns)


def _filter(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not leaks_of(ids, index) for _, texts in text_chunks(batch, "text") for ids in _coded(texts, index.items.words)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
