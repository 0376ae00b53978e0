"""SimHash near-duplicates (operator 5).

Fingerprints are 64-bit; two link at ``most`` (4) or fewer differing bits.

Candidates come from pigeonholing: of six segments of a fingerprint, four differing
bits leave at least two untouched, so linked fingerprints share one of the fifteen
pairs of segments.  Inside such a bucket a Gray-order hierarchical index finds the
links, whatever the bucket's size: fingerprints sorted by Gray rank are cut into
groups; a node keeps the bit pattern its group shares (mask and value), an inner node
the pattern its children share; a pair of nodes is dropped with everything below it
once the differences accumulated over the bits known to both exceed the limit.

Only distinct fingerprints are indexed, buckets are dealt in bounded chunks, and a
bucket reports the edges of its classes, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import bucket_join, components, in_small_batches, join_hot, may_meet, merge_labels, stash
from siftwell.llm.packing import text_chunks

SEED = 42
SHINGLE = 4
MOST = 4
#: Widths of the six segments.
SEGMENTS = (11, 11, 11, 11, 10, 10)
#: Fingerprints that one task group indexes at most.
BUCKET = 4_096
#: Rows under a leaf of the index, and nodes under an inner node.
LEAF, FAN = 8, 8
#: Row pairs that are compared at once.
LANES = 1 << 20


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles (words: runs without ASCII white space, A-Z lower-cased), repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        cuts = [joined[a:b] for a, b in zip(starts[k : min(n, k + (1 << 16))].tolist(), last[k : k + (1 << 16)].tolist(), strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(SEED)), dtype="<u8", count=len(cuts))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t) for _, texts in text_chunks(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(made, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _nodes(mask: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit patterns (mask and value) that the children from each of ``first`` on share."""
    ones = np.bitwise_and.reduceat(mask & value, first)
    zeros = np.bitwise_and.reduceat(mask & ~value, first)
    return ones | zeros, ones


def _cut(owner: np.ndarray, width: int) -> np.ndarray:
    """Where runs of at most ``width`` start, none of which crosses from one owner to the next."""
    opens = np.append(True, owner[1:] != owner[:-1])
    begin = np.flatnonzero(opens)
    place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
    return np.flatnonzero(place % width == 0)


def _longest(owner: np.ndarray) -> int:
    """Most nodes of one owner."""
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return int(np.diff(np.append(begin, len(owner))).max())


def _opened(a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of node ``a`` and one of node ``b``, each unordered pair once; node k has children ``cuts[k]`` to ``cuts[k + 1]``."""
    wide = cuts[b + 1] - cuts[b]
    many = (cuts[a + 1] - cuts[a]) * wide
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    wide = np.repeat(wide, many)
    i, j = np.repeat(cuts[a], many) + nth // wide, np.repeat(cuts[b], many) + nth % wide
    return i[i <= j], j[i <= j]


def link_classes(fp: np.ndarray, side: np.ndarray, owner: np.ndarray | None = None, most: int = MOST) -> np.ndarray:
    """Smallest position of each fingerprint's class under links of ``most`` bits, by the hierarchical index.

    ``owner`` numbers the buckets, in each of which an index is built and searched (all
    of them together, level by level); without it there is one bucket.  Rows of sides 0
    and 1 meet only the other side; side -1 meets all.
    """
    n = len(fp)
    owner = np.zeros(n, np.int64) if owner is None else owner
    order = np.lexsort((gray_rank(fp), owner))
    x, s, labels = fp[order], side[order], np.arange(n)
    levels = [(np.full(n, ~np.uint64(0)), x, owner[order], np.zeros(0, np.int64))]
    width = LEAF
    while len(levels) == 1 or _longest(levels[-1][2]) > FAN:
        mask, value, of, _ = levels[-1]
        first = _cut(of, width)
        levels.append((*_nodes(mask, value, first), of[first], np.append(first, len(of))))
        width = FAN
    top = levels[-1][2]
    begin = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    a, b = _opened(np.arange(len(begin)), np.arange(len(begin)), np.append(begin, len(top)))
    for level in range(len(levels) - 1, 0, -1):
        mask, value, _, cuts = levels[level]
        apart = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b])
        a, b = a[apart <= most], b[apart <= most]
        if level > 1:
            a, b = _opened(a, b, cuts)
    cuts = levels[1][3]
    done = np.append(0, np.cumsum((cuts[a + 1] - cuts[a]) * (cuts[b + 1] - cuts[b])))
    k = 0
    while k < len(a):
        stop = max(k + 1, int(np.searchsorted(done, done[k] + LANES)))
        i, j = _opened(a[k:stop], b[k:stop], cuts)
        near = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= most) & may_meet(s, i, j)
        labels = merge_labels(labels, i[near], j[near])
        k = stop
    out = np.empty(n, dtype=np.int64)
    # the class is named by its smallest position in the order that was given
    low = np.full(n, n)
    np.minimum.at(low, labels, order)
    out[order] = low[labels]
    return out


def _within(frame: pd.DataFrame, cuts: np.ndarray, side: np.ndarray) -> pd.DataFrame:
    """Edges from the first row of every class to its others."""
    rep = frame["rep"].to_numpy()
    label = link_classes(frame["fp"].to_numpy().view(np.uint64), side, np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)))
    other = label != np.arange(len(rep))
    return pd.DataFrame({"src": rep[label[other]], "dst": rep[other]})


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges ``src, dst`` that connect all linked fingerprints of ``distinct(fp, rep)``."""
    ends = np.cumsum(SEGMENTS).tolist()
    spans = [(e - w, w) for e, w in zip(ends, SEGMENTS, strict=True)]
    piece = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1)) for at, w in spans]
    keys = F.array(*(F.shiftleft(piece[i], 22).bitwiseOR(F.shiftleft(piece[j], 11)).bitwiseOR(F.lit(k)) for k, (i, j) in enumerate(combinations(range(6), 2))))
    return bucket_join(distinct.select(F.explode(keys).alias("bucket"), "fp", "rep"), _within, "src long, dst long", key="bucket", ident="fp", most=BUCKET)


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links.  Null and empty
    texts have fingerprint zero and link like any other; repeated rows repeat; rows
    with a null doc_id get a fingerprint but never name a component of others; other
    columns are ignored; an empty table gives an empty one.
    """
    made = stash(fingerprints(docs))
    distinct = stash(made.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("rep is not null"))
    found = components(fingerprint_links(distinct))
    named = stash(distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")))
    return join_hot(made, named, ["fp"], "n", "doc_id", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document names its group; rows without a doc_id stay, rows that share one stay or go together."""
    groups = simhash_groups(docs).where("doc_id is not null")
    gone = groups.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
