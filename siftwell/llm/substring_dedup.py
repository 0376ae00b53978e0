"""Repeated passages (operator 2): paragraph MinHash banding, verified, removed by components.

Units are of two kinds and go the same way:

* paragraphs - the lines of five words or more - by MinHash banding over five-word
  shingles; colliding paragraphs are verified by their exact Jaccard (0.8 or more);
* windows of ``WINDOW`` words, placed by the text itself (the smallest hash of three
  words among any ``REACH`` neighbours), for passages that were pasted into the middle
  of a paragraph.  A window has so few shingles that a Jaccard of 0.8 means equal words,
  so one band, the hash of the whole, has full recall.  A passage of
  ``REACH + WINDOW + 2`` = 50 words holds a whole window wherever it stands.

Equal units are one class before any bucket is made; of the distinct paragraphs only
those that share a band bucket have their shingles fetched.  Classes that are linked
form components, of which the first unit (by doc_id, then place) stays.

A window that is to go is followed word by word, to the left and to the right, beside
the one that stays for as long as the two texts agree (and further beside the first of
those that part from it alike), so that a passage goes from its first word to its last.  What goes from a document is merged; runs of fewer than
``least_chars`` code points (commonplace lines and phrases) stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm._shared import bucket_join, components, discard, in_small_batches, join_hot, large_groups, may_meet, merge_labels, small_pairs, stash
from siftwell.llm.packing import text_chunks

SHINGLE = 5
WINDOW, REACH = 18, 30
#: Words beside a window that are compared with those beside its copy.
MARGIN = REACH + 2
#: Bands and hashes a band: two paragraphs of Jaccard 0.8 meet with probability 0.983.
BANDS, ROWS = 4, 2
LEAST = 0.8
#: Code points of the shortest run that is removed: about twenty words.
LEAST_CHARS = 120
BUCKET, SMALL = 512, 16
MEMORY = 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_SEEDS = np.array([(k * _STEP + 0x1234567) & (2**64 - 1) for k in range(1, BANDS * ROWS + 1)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _gram(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    size = len(h) - n + 1
    out = np.zeros(max(size, 0), dtype=np.uint64)
    if size > 0:
        for k in range(n):
            out = out * np.uint64(0x100000001B3) + h[k : k + size]
    return mix(out)


#: Odd factors, two for each place of a window, from the same sequence as the seeds.
_FACTORS = mix(np.arange(1, 2 * WINDOW + 1, dtype=np.uint64) * np.uint64(_STEP)).reshape(2, WINDOW) | np.uint64(1)


def _folded(rows: np.ndarray, which: int) -> np.ndarray:
    """One hash a row of word hashes: a sum with a factor for each place."""
    return mix((rows * _FACTORS[which]).sum(axis=1, dtype=np.uint64))


class _Known(dict):
    """Hashes of words, made as they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = made = xxhash.xxh64_intdigest(word.lower().encode())
        return made


class _Hashes:
    """Word hashes of texts: words are runs without blanks and line ends, lower case."""

    def __init__(self) -> None:
        self.known = _Known()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end (code points) of each word."""
        if len(self.known) > MEMORY:
            self.known.clear()
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        h = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size + 1) - 1
        real = size > 0
        return h[real], (end - size)[real], end[real]


def anchors(h: np.ndarray) -> np.ndarray:
    """Word places that hold the smallest three-word hash of some ``REACH`` consecutive ones."""
    g = _gram(h, 3)
    if not len(g):
        return np.zeros(0, np.int64)
    if len(g) <= REACH:
        return np.array([int(g.argmin())])
    out = []
    for k in range(0, len(g) - REACH + 1, 1 << 16):  # in parts, for very long texts
        part = g[k : k + (1 << 16) + REACH - 1]
        out.append(np.unique(np.lib.stride_tricks.sliding_window_view(part, REACH).argmin(axis=1) + np.arange(len(part) - REACH + 1)) + k)
    return _thinned(np.unique(np.concatenate(out)), g)


def _thinned(at: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Without places that repeat the last one's words and may go without leaving more than ``REACH`` between two.

    Text that repeats a word or a phrase over and over would otherwise have a window at every turn.
    """
    if not (g[at[1:]] == g[at[:-1]]).any():
        return at
    value, places = g[at].tolist(), at.tolist()
    kept = [0]
    for k in range(1, len(places)):
        needed = k + 1 == len(places) or places[k + 1] - places[kept[-1]] > REACH
        if needed or value[k] != value[kept[-1]]:
            kept.append(k)
    return at[kept]


def _sketches(five: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """One key for each band and range of shingles, all ranges at once."""
    low = np.minimum.reduceat(mix(five[None, :] ^ _SEEDS[:, None]), ranges.ravel(), axis=1)[:, ::2].reshape(BANDS, ROWS, -1)
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], low.shape[2], axis=1)
    for k in range(ROWS):
        out = mix(out * np.uint64(_STEP) + low[:, k])
    return out.T


def _lines(text: str, start: np.ndarray) -> np.ndarray:
    """Word ranges of the lines of ``SHINGLE`` words or more."""
    ends = np.cumsum(np.fromiter(map(len, text.split("\n")), dtype=np.int64) + 1)
    cuts = np.concatenate(([0], np.searchsorted(start, ends)))
    keep = np.diff(cuts) >= SHINGLE
    return np.stack([cuts[:-1][keep], cuts[1:][keep]], axis=1)


def _low32(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _links(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each window a hash of the words up to the end of the next one: equal if what lies between is equal."""
    out = np.zeros(len(at), dtype=np.uint64)
    if len(at) > 1:
        raw = h.tobytes()
        out[:-1] = [xxhash.xxh64_intdigest(raw[8 * a : 8 * (b + WINDOW)]) | 1 for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


_UNITS = "doc_id long, start int, end int, key long, check int, link int, bands array<long>, unit long"
_UNIT_SHAPE = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.int64()), ("check", pa.int32()), ("link", pa.int32()), ("bands", pa.list_(pa.int64())), ("unit", pa.int64())])


def units(docs: DataFrame) -> DataFrame:
    """All units of ``docs(doc_id, text)``.

    ``key`` and ``check`` hash the words of a window, or the distinct shingles of a
    paragraph; a window's ``link`` hashes what stands from its first word to the last of the
    next window; paragraphs have one MinHash key for each of their ``bands``.  ``unit``
    numbers the paragraphs.
    """

    def frame(parts: list[tuple], bands: pa.Array | None, unit: pa.Array | None) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        n = len(columns[0])
        fixed = [pa.array(c.astype(t.type.to_pandas_dtype(), copy=False)) for c, t in zip(columns, _UNIT_SHAPE, strict=False)]
        return pa.RecordBatch.from_arrays([*fixed, pa.nulls(n, _UNIT_SHAPE[6].type) if bands is None else bands, pa.nulls(n, pa.int64()) if unit is None else unit], schema=_UNIT_SHAPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = _Hashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            owners = batch.column("doc_id").to_numpy()
            for first, texts in text_chunks(batch, "text"):
                windows: list[tuple] = []
                lines: list[tuple] = []
                bands: list[np.ndarray] = []
                for k, text in enumerate(texts):
                    h, start, end = words(text)
                    owner = owners[first + k]
                    if len(h) < SHINGLE:
                        continue
                    if len(h) >= WINDOW:
                        at = anchors(h)
                        at = at[at + WINDOW <= len(h)]
                        own = h[at[:, None] + np.arange(WINDOW)]
                        windows.append((np.full(len(at), owner), start[at], end[at + WINDOW - 1], _folded(own, 0).view(np.int64), _low32(_folded(own, 1)), _low32(_links(h, at))))
                    ranges = _lines(text, start)
                    if len(ranges):
                        five = _gram(h, SHINGLE)
                        stops = ranges - np.array([0, SHINGLE - 1])
                        # a last stop that is the end of the shingles would be no index
                        padded = np.append(five, ~np.uint64(0)) if stops[-1, 1] == len(five) else five
                        bands.append(_sketches(padded, stops))
                        sets = [np.unique(five[a:b]).tobytes() for a, b in stops.tolist()]
                        key = np.array([xxhash.xxh64_intdigest(x) for x in sets], dtype=np.uint64).view(np.int64)
                        check = np.array([xxhash.xxh32_intdigest(x) for x in sets], dtype=np.uint32).view(np.int32)
                        lines.append((np.full(len(ranges), owner), start[ranges[:, 0]], end[ranges[:, 1] - 1], key, check, np.zeros(len(ranges), np.int32)))
                if windows:
                    yield frame(windows, None, None)
                if lines:
                    flat = np.concatenate(bands).view(np.int64)
                    yield frame(lines, pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, BANDS), pa.int32()), pa.array(flat.ravel())), pa.array(np.arange(number, number + len(flat))))
                    number += len(flat)

    return _texts(docs).mapInArrow(run, _UNITS)


def _texts(docs: DataFrame) -> DataFrame:
    chosen = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.where("doc_id is not null and text is not null")


def _verify(frame: pd.DataFrame, cuts: np.ndarray, side: np.ndarray) -> pd.DataFrame:
    """Edges between paragraphs of one band bucket whose Jaccard is ``LEAST`` or more."""
    label = np.arange(len(frame))
    sets = frame["shingles"].to_numpy()
    whole, unit = frame["key"].to_numpy(), frame["unit"].to_numpy()
    held: dict[int, frozenset] = {}

    def as_set(k: int) -> frozenset:
        if k not in held:
            held[k] = frozenset(sets[k].tolist())
        return held[k]

    for i, j in small_pairs(cuts, SMALL):
        keep = may_meet(side, i, j) & (label[i] != label[j])
        i, j = i[keep], j[keep]
        near = whole[i] == whole[j]
        for k in np.flatnonzero(~near).tolist():
            a, b = as_set(int(i[k])), as_set(int(j[k]))
            both = len(a & b)
            near[k] = both >= LEAST * (len(a) + len(b) - both)
        label = merge_labels(label, i[near], j[near])
    for a, b in large_groups(cuts, SMALL):
        label[a:b] = a + _large(sets[a:b], whole[a:b], side[a:b])
    other = label != np.arange(len(frame))
    return pd.DataFrame({"src": unit[label[other]], "dst": unit[other]})


def _large(sets: np.ndarray, whole: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Classes of one bucket: equal sets first, the distinct ones by a count of common shingles."""
    n = len(sets)
    # one row for each distinct set and side
    _, first, back = np.unique(np.stack([whole, side.astype(np.int64)], axis=1), axis=0, return_index=True, return_inverse=True)
    back = back.ravel()
    size = np.array([len(sets[k]) for k in first], dtype=np.int64)
    values = np.concatenate([sets[k] for k in first])
    owner = np.repeat(np.arange(len(first)), size)
    shingle, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    renumber = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], renumber[column[keep]]
    common = np.zeros((len(first), len(first)), dtype=np.float32)
    for c in range(0, int(shared.sum()), 4096):
        part = (column >= c) & (column < c + 4096)
        grid = np.zeros((len(first), 4096), dtype=np.float32)
        grid[owner[part], column[part] - c] = 1
        common += grid @ grid.T
    near = common >= LEAST * (size[:, None] + size[None, :] - common) - 1e-3
    i, j = np.nonzero(np.triu(near, 1))
    keep = may_meet(side[first], i, j)
    of = merge_labels(np.arange(len(first)), i[keep], j[keep])
    # rows of one set are equal, so they belong to one class whatever their side
    label = np.arange(n)
    order = np.argsort(of[back], kind="stable")
    group = of[back][order]
    head = np.append(True, group[1:] != group[:-1])
    label[order] = np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), n)))
    return label


_ASKED = "kind string, doc_id long, start int, unit long, key long, shingles array<long>, words array<int>, places array<int>"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is asked of each document: the shingles of a line, or the words on one side of a window and where they end.

    ``asks`` holds structs of kind (``set``, ``left``, ``right``), first code point, end, unit and key.
    """
    words = _Hashes()
    for batch in batches:
        owners, asks = batch.column("doc_id").to_pylist(), batch.column("asks").to_pylist()
        for first, texts in text_chunks(batch, "text"):
            rows: list[tuple] = []
            for k, text in enumerate(texts, first):
                h, start, end = words(text)
                five, short = _gram(h, SHINGLE), _low32(h)
                for ask in asks[k]:
                    kind, a = ask["kind"], int(np.searchsorted(start, ask["start"]))
                    row = (kind, owners[k], ask["start"], ask["unit"], ask["key"])
                    if kind == "set":
                        b = int(np.searchsorted(start, ask["end"]))
                        rows.append((*row, np.unique(five[a : b - SHINGLE + 1]).view(np.int64), None, None))
                    elif kind == "left":
                        side = slice(max(a - MARGIN, 0), a)
                        rows.append((*row, None, short[side][::-1], start[side][::-1]))
                    else:
                        side = slice(a + WINDOW, a + WINDOW + MARGIN)
                        rows.append((*row, None, short[side], end[side]))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "doc_id", "start", "unit", "key", "shingles", "words", "places"])


def _runs(seeds: DataFrame) -> DataFrame:
    """The seeds that are to go, each up to the end of the next one if the run goes on to it, and the ``sides`` on which it ends.

    A run goes on from a window to the next one if both repeat one text (the same shift
    against one document) and what lies between is equal there.
    """
    here = Window.partitionBy("doc_id").orderBy("start", "key")
    marked = seeds.withColumn("_shift", F.col("start") - F.col("keep.start"))
    same = lambda way: (way("keep.doc_id").over(here) == F.col("keep.doc_id")) & (way("_shift").over(here) == F.col("_shift"))
    linked = lambda c, kept: (c != 0) & (c == kept)
    marked = marked.select(
        "*",
        F.coalesce(same(F.lag) & linked(F.lag("link").over(here), F.lag("keep.link").over(here)), F.lit(False)).alias("_before"),
        F.coalesce(same(F.lead) & linked(F.col("link"), F.col("keep.link")), F.lit(False)).alias("_after"),
        F.lead("end").over(here).alias("_next"),
    )
    marked = marked.where("doc_id <> keep.doc_id or start <> keep.start")
    sides = F.array_compact(F.array(F.when(~F.col("_before"), F.lit("left")), F.when(~F.col("_after"), F.lit("right"))))
    return marked.select("doc_id", "start", F.when(F.col("_after"), F.col("_next")).otherwise(F.col("end")).alias("end"), "key", "check", "keep", sides.alias("sides"))


def _longer(rows: DataFrame, across: str) -> DataFrame:
    """The spans to add beside ends: ``rows`` have the end's ``words`` and ``places`` and the ``kept_words`` of the one that stays.

    Ends that part from what stays at one word and with the same word go on together, beside
    the first of them, until no two do: a trie, walked one branching at a time.
    """
    spans, group = None, ["key", "kind", "check", "path"]
    rows = rows.withColumn("path", F.lit(0).cast("long"))
    while True:
        differs = F.array_position(F.zip_with("words", "kept_words", lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1)), 1)
        rows = stash(rows.withColumn("many", F.when(differs == 0, F.size("words")).otherwise(differs - 1).cast("int")).drop("kept_words"))
        reach, left = F.element_at("places", F.col("many")), F.col("kind") == "left"
        own = rows.where("many > 0").select("doc_id", F.when(left, reach).otherwise(F.col("start")).alias("start"), F.when(left, F.col("start")).otherwise(reach).alias("end"), "keep")
        spans = own if spans is None else spans.unionByName(own)
        open_ = rows.where("many < size(words)").withColumn("path", F.xxhash64("path", "many", F.get("words", F.col("many")))).drop("many", "keep")
        first = F.min_by(F.struct("doc_id", "start", "words"), F.struct("doc_id", "start")).alias("keep")
        groups = stash(open_.groupBy(*group).agg(first, F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where(across))
        if groups.isEmpty():
            return spans
        met = join_hot(open_, groups, group, "n", "doc_id").where("doc_id <> keep.doc_id or start <> keep.start")
        rows = met.withColumn("kept_words", F.col("keep.words")).withColumn("keep", F.struct("keep.doc_id", "keep.start")).select("kind", "doc_id", "start", "key", "check", "words", "places", "kept_words", "keep", "path")


def repeated_passages(docs: DataFrame, *, least_chars: int = LEAST_CHARS, within: bool = False) -> DataFrame:
    """``doc_id, start, end, n_units, first_doc_id``: what to cut out of each document.

    Offsets are code points, ends exclusive; the first occurrence of a passage stays, in
    document ``first_doc_id``; ``n_units`` counts the paragraphs and windows (with what was
    added beside them) merged.  Only runs of ``least_chars`` code points or more are given.  Passages
    that only one document repeats count if ``within`` is set.  Null and empty texts and
    lines of fewer than five words have no units.  Rows that share a doc_id count as one
    document, rows without one take no part; other columns are ignored; an empty table gives an empty result.
    """
    made = stash(units(docs))
    place, one = F.struct("doc_id", "start"), F.count(F.lit(1)).alias("n")
    across = "n > 1" if within else "n > 1 and keep.doc_id <> last"
    # windows: equal ones are a class, and its own component
    windows = made.where("bands is null").select("key", "check", "doc_id", "start", "end", "link")
    same = windows.groupBy("key", "check").agg(F.min(F.struct("doc_id", "start", "link")).alias("keep"), F.max("doc_id").alias("last"), one)
    shared = stash(same.where(across).select("key", "check", "keep", "n"))
    seeds = stash(join_hot(windows, shared, ["key", "check"], "n", "doc_id").select("doc_id", "start", "end", "key", "check", "link", "keep", "n"))
    runs = stash(_runs(seeds))
    ends = runs.select(F.explode("sides").alias("kind"), "doc_id", "start", "key", "check", "keep")
    # paragraphs: equal ones are a class, the distinct ones meet in bands
    lines = made.where("bands is not null")
    classes = stash(lines.groupBy("key", "check").agg(F.min("unit").alias("rep"), F.min(place).alias("keep"), F.max("doc_id").alias("last"), F.min_by(F.struct("doc_id", "start", "end", "bands"), "unit").alias("head"), one))
    banded = classes.select(F.col("rep").alias("unit"), F.explode("head.bands").alias("bucket"))
    crowd = stash(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = stash(join_hot(banded, crowd, ["bucket"], "n", "unit").select("unit", "bucket"))
    # one pass fetches the shingles of the paragraphs that met and the words beside the ends of runs
    sets = classes.join(met.select(F.col("unit").alias("rep")).distinct(), "rep", "left_semi").select("head.doc_id", F.struct(F.lit("set").alias("kind"), F.col("head.start").alias("start"), F.col("head.end").alias("end"), F.col("rep").alias("unit"), "key").alias("ask"))
    no = F.lit(None)
    beside = ends.select("doc_id", "kind", "start", "key").unionByName(ends.select("keep.doc_id", "kind", "keep.start", "key")).distinct()
    beside = beside.select("doc_id", F.struct("kind", "start", no.cast("int").alias("end"), no.cast("long").alias("unit"), "key").alias("ask"))
    asked = sets.unionByName(beside).groupBy("doc_id").agg(F.collect_list("ask").alias("asks"))
    got = stash(_texts(docs).join(asked, "doc_id").select("doc_id", "text", "asks").mapInArrow(_fetch, _ASKED))
    # near paragraphs
    edges = bucket_join(met, _verify, "src long, dst long", key="bucket", ident="unit", most=BUCKET, payload=got.where("kind = 'set'").select("unit", "key", "shingles").dropDuplicates(["unit"]))
    found = components(edges)
    named = stash(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "rep")).select("key", "check", "component", "keep", "last", "n"))
    kept = named.groupBy("component").agg(F.min("keep").alias("keep"), F.max("last").alias("last"), F.sum("n").alias("n")).where(across).select("component", "keep")
    going = named.select("key", "check", "component", "n").join(kept, "component")
    spans = join_hot(lines.select("key", "check", "doc_id", "start", "end"), stash(going), ["key", "check"], "n", "doc_id").select("doc_id", "start", "end", "keep.doc_id", "keep.start")
    # the words beside a window, against those beside the one that stays
    sides = ["key", "kind", "check"]
    words = got.where("kind <> 'set'").select("kind", "doc_id", "start", "key", "words", "places").dropDuplicates(["kind", "doc_id", "start", "key"])
    own = ends.join(words, ["kind", "doc_id", "start", "key"]).withColumn("keep", F.struct("keep.doc_id", "keep.start"))
    stay = ends.groupBy(*sides).agg(F.first("keep").alias("keep"), one)
    stay = stay.select(*sides, "n", F.col("keep.doc_id").alias("doc_id"), F.col("keep.start").alias("start"))
    stay = stash(stay.join(words.select("kind", "doc_id", "start", "key", F.col("words").alias("kept_words")), ["kind", "doc_id", "start", "key"]).select(*sides, "n", "kept_words"))
    longer = _longer(join_hot(own, stay, sides, "n", "doc_id").drop("n"), across)
    columns = ["doc_id", "start", "end", F.col("keep.doc_id").alias("first_doc_id"), F.col("keep.start").alias("first_start")]
    cut = runs.select(*columns).unionByName(longer.select(*columns)).unionByName(spans.toDF("doc_id", "start", "end", "first_doc_id", "first_start"))
    cut = stash(cut.where("doc_id <> first_doc_id or start <> first_start").drop("first_start"))
    discard(made)
    return _merged(cut).where(F.col("end") - F.col("start") >= least_chars)


def _merged(cut: DataFrame) -> DataFrame:
    """Overlapping and adjoining spans of each document as one."""
    one = cut.groupBy("doc_id", "start", "end").agg(F.min("first_doc_id").alias("first_doc_id"))
    so_far = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    # between two words stands one blank or line end
    runs = one.withColumn("opens", F.when(F.col("start") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("opens").over(so_far))
    merged = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.min("first_doc_id").alias("first_doc_id"))
    return merged.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_units", "first_doc_id")


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the passages cut out of ``text``; documents without any are untouched.

    Every row stays, repeated ones too, with all columns whatever their names; a null
    text stays null and a null doc_id has no passages; an empty table stays empty.
    """
    per_doc = passages.groupBy(F.col("doc_id").alias("_passage_doc")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_passage_cuts"))
    joined = docs.join(per_doc, docs["doc_id"] == per_doc["_passage_doc"], "left")
    text, cuts = docs["text"], F.col("_passage_cuts")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda c: c["end"]))
    starts = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.char_length(text).cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substr(text, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    new = F.when(cuts.isNotNull() & text.isNotNull(), F.array_join(parts, "")).otherwise(text)
    return joined.select(*(new.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns))
