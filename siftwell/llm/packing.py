"""Sequence packing by minimum bin slack (operator 8).

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the
plan is made from the histogram of lengths: per bin, a bitset subset-sum dynamic
programme finds the fullest combination of what is left around the longest piece,
and that combination is removed as often as the histogram allows.  Plan and
histogram are bounded by ``capacity`` whatever the corpus holds; pieces find their
place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm._shared import in_small_batches, stash

CAPACITY = 2048
END_ID = 0
#: Words whose ids a Python worker remembers at most.
MEMORY = 400_000
#: Characters of text that are tokenized together.
CHUNK = 400_000

_CACHES: dict[str, tuple[object, dict[str, bytes]]] = {}


def _byte_letters() -> dict[int, int]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in plain)}


class _Words:
    """Ids of texts as little-endian 32-bit bytes, word by word, with a bounded memory.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its space-separated words.  A word of Latin letters is one unit of the
    vocabulary's own merging: unseen ones are merged together in one call without the
    costly normaliser and told apart by the ids that end a word.  Punctuation behind
    such a word, or behind an ASCII letter or digit, is a unit of its own.  All other
    words go through the full tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = None
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {"": b""}

    def _alone(self, word: str) -> bytes:
        return np.asarray(self.model.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _as_unit(self, word: str) -> str | None:
        """``word`` as the merger wants it, where it is one unit of lower-case Latin letters."""
        if not word.isalpha() or max(word) >= "\u0250":
            return None
        if word.isascii():
            return word.lower()
        lower = word if word.islower() else "".join(c.lower() for c in word)
        return lower.encode().decode("latin-1").translate(self.letters) if lower.isalpha() else None

    def _learn(self, words: set[str]) -> None:
        known, units, split, other = self.known, {}, [], set()
        for w in words:
            base = w.rstrip(".,;:!?\"')]}*#$%&")
            tail = w[len(base) :]
            # behind a symbol the tail would be part of that symbol's unit
            if base in known and tail in known and base[-1:].isascii() and base[-1:].isalnum():
                known[w] = known[base] + known[tail]
            elif (unit := self._as_unit(base)) is not None:
                units[base] = unit
                if tail:
                    split.append((w, base, tail))
                    if tail not in known:
                        other.add(tail)
            else:
                other.add(w)
        for w in other:
            known[w] = self._alone(w)
        if units:
            ids = np.asarray(self.merger.encode_batch_fast([" ".join(units.values())], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data, at = ids.tobytes(), 0
            for base, end in zip(units, cuts, strict=True):
                known[base] = data[at:end]
                at = end
        for w, base, tail in split:
            known[w] = known[base] + known[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY:
            self.known = {"": b""}
        known = self.known
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if new := {w for ws in split for w in ws if w not in known}:
            self._learn(new)
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def _words(path: str) -> _Words:
    if path not in _CACHES:
        _CACHES[path] = _Words(path)
    return _CACHES[path]


def text_chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch in runs of about ``most`` characters: ``(first row, texts)``; null is empty."""
    texts = batch.column(column)
    size = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most)))
        yield at, [t or "" for t in texts.slice(at, stop - at).to_pylist()]
        at = stop


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Cut documents into pieces of at most ``capacity`` ids, each document ended by id 0.

    ``doc_id, piece, start, length, ids_crc32`` (with ``keep_ids`` also ``ids``, the
    little-endian 32-bit ids), and ``part``, ``nth``: the piece's rank among those of
    its length in its partition.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    if keep_ids:
        fields.append(("ids", pa.binary()))
        kinds += ", ids binary"
    shape = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = _words(tokenizer_path), TaskContext.get().partitionId(), Counter()
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            owners = batch.column("doc_id").to_pylist()
            for at, texts in text_chunks(batch, "text"):
                rows: list[tuple] = []
                for k, data in enumerate(words.encode(texts)):
                    data += end
                    for n, b in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[b : b + 4 * capacity]
                        size = len(cut) // 4
                        rows.append((owners[at + k], n, b // 4, size, zlib.crc32(cut), part, seen[size], *([cut] if keep_ids else [])))
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=shape)

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def fullest(room: int, left: dict[int, int], order: list[int]) -> dict[int, int]:
    """The multiset of ``left`` (length: count) with the largest sum of at most ``room``.

    Reachable sums are the bits of one integer; copies of a length are added in
    binary parts, longest lengths first, until ``room`` itself is reached.
    """
    full = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for size in order:
        if size > room:
            continue
        many, chunk = min(left[size], room // size), 1
        while many > 0:
            take = min(chunk, many)
            layers.append((size, take, reach))
            reach |= (reach << (size * take)) & full
            many -= take
            chunk *= 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(layers):
        if not before >> best & 1:
            used[size] = used.get(size, 0) + take
            best -= size * take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack over a histogram of lengths: ``(bins, lengths in each)``."""
    left = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(left, reverse=True)
    plan = []
    while order:
        top = order[0]
        left[top] -= 1
        used = fullest(capacity - top, left, order) if top < capacity else {}
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= times * n
        order = [k for k in order if left[k]]
        plan.append((times, used))
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Per length and run of ranks: the first bin, copies a bin, and offset inside it; sorted by (length, rank)."""
    rank: Counter = Counter()
    rows, first = [], 0
    for times, used in plan:
        offset = 0
        for size, n in sorted(used.items(), reverse=True):
            rows.append((size, rank[size], first, n, offset))
            rank[size] += n * times
            offset += n * size
        first += times
    rows.sort()
    return dict(zip(("size", "rank", "first", "copies", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Place every piece of ``docs(doc_id, text)``: its columns plus ``sequence_id`` and ``offset``.

    Null and empty texts are the single id 0.  Rows that share a doc_id stay separate
    documents; an empty table packs into nothing; other columns are ignored.
    """
    pieces = stash(tokenize_pieces(docs, tokenizer_path, capacity=capacity, keep_ids=keep_ids))
    counts = stash(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan_bins(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    # this side grows with the partitions, so it is merged and never broadcast
    shift = counts.select("part", "length", before.alias("before")).hint("merge")
    spread = int(max(histogram.values(), default=0)) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key for (length, rank); ranks are below ``spread``
        keys = slots["size"] * spread + slots["rank"]
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, size * spread + rank, side="right") - 1
            inside = rank - slots["rank"][at]
            copies = slots["copies"][at]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(slots["first"][at] + inside // copies), pa.array(slots["offset"][at] + inside % copies * size)],
                names=[*kept, "sequence_id", "offset"],
            )

    ranked = pieces.join(shift, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if keep_ids else []))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long")
