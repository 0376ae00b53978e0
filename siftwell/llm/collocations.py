"""Phrase collocation mining by count tries (operator 13).

Every shard of texts builds count tries: nodes are the phrases of one to four words of a
language, in sorted order, each with its occurrences.  The serialised tries are merged by
ranges of their paths, so a frequent first word is spread over many ranges.  The tries are
built in two turns: the first has nodes of depth 0 to 2 (depth 0 counts all words), the second
depth 3 and 4, but only along pairs of words that are frequent in their language (a phrase is
never more frequent than the pairs in it; a Bloom filter of bounded size names them, and its
errors only make nodes that the merge drops).

In the merged trie a walk in path order meets all prefixes of a node before it: they are the
left parts of its cuts.  Suffix links lead from a node to the nodes of its right parts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm._shared import LOWER, UPPER, in_small_batches, join_hot, stash

LEAST, DEEPEST, ABSORBED, FIRST = 30, 4, 80, 2_000
#: Tokens and different words that a trie is built from at most, bytes that are split at a time.
TOKENS, WORDS, STRETCH = 4_000_000, 1_500_000, 1 << 20
#: Bits of the filter of frequent pairs: so many for each, between these bounds.
BITS_EACH, FEWEST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27
#: Cuts between the slices that are walked.
SLICES = 512
_NODES = "lang string, phrase string, depth int, f long"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("depth", pa.int32()), ("f", pa.int64())])
_BYTES = bytes.maketrans(UPPER.encode() + b"\t.,;:!?\x0a\x0b\x0c\x0d", LOWER.encode() + b" " + b"\n" * 10)
_BREAK = b"\n"


def _stretches(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    start = 0
    while start < len(text):
        end = text.find(b" ", start + STRETCH)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False).astype(np.uint64)


class _Pairs:
    """Bloom filter of pairs of words: two bits for each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def slots(self, pair: np.ndarray) -> np.ndarray:
        return np.stack([pair & self.mask, (pair >> np.uint64(32)) & self.mask])

    def holds(self, pair: np.ndarray) -> np.ndarray:
        out = np.ones(len(pair), dtype=bool)
        for slot in self.slots(pair):
            out &= (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return out


class _Shard:
    """Words of a shard's texts as numbers, until there are enough for a trie."""

    def __init__(self, depths: tuple[int, ...], pairs: _Pairs | None):
        self.depths, self.pairs = depths, pairs
        self.known: dict[bytes, int] = {}
        self.langs: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.of: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        number = self.langs.setdefault(lang, len(self.langs))
        data = text.encode("utf-8", "surrogatepass").translate(_BYTES).replace(_BREAK, b" \n ")
        for part in _stretches(data):
            codes, found = pd.factorize(np.array([*part.split(b" "), b""], dtype=object)[:-1])
            known = self.known
            own = np.fromiter((-2 if w == b"" else -1 if w == _BREAK else known.setdefault(w, len(known)) for w in found), dtype=np.int64, count=len(found))
            ids = own[codes] if len(found) else own
            ids = ids[ids != -2]
            self._append(ids, number)
            if self.size >= TOKENS or len(known) >= WORDS:
                yield from self.flush(open_text=True)
                number = self.langs.setdefault(lang, len(self.langs))
        self._append(np.array([-1]), number)

    def _append(self, ids: np.ndarray, lang: int) -> None:
        self.ids.append(ids)
        self.of.append(np.full(len(ids), lang))
        self.size += len(ids)

    def flush(self, *, open_text: bool = False) -> Iterator[pa.RecordBatch]:
        """The trie's nodes in sorted order.  Of an open text the last words stay, as phrases may go on behind them."""
        if not self.size:
            return
        ids, of = np.concatenate(self.ids), np.concatenate(self.of)
        stay = min(DEEPEST - 1, len(ids)) if open_text else 0
        words, langs = list(self.known), list(self.langs)
        tail, tail_lang = ids[len(ids) - stay :], langs[of[-1]]
        yield from self._trie(ids, of, words, langs, len(ids) - stay)
        self.known, self.langs, self.ids, self.of, self.size = {}, {}, [], [], 0
        if stay:
            kept = np.array([i if i < 0 else self.known.setdefault(words[i], len(self.known)) for i in tail])
            self._append(kept, self.langs.setdefault(tail_lang, 0))

    def _trie(self, ids: np.ndarray, of: np.ndarray, words: list[bytes], langs: list[str], starts: int) -> Iterator[pa.RecordBatch]:
        text = pa.array(words, pa.binary())
        order = pc.sort_indices(text).to_numpy()
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        text = text.take(pa.array(order)).cast(pa.string())
        ids = np.where(ids >= 0, rank[np.maximum(ids, 0)] if len(rank) else -1, -1)
        v = max(len(words), 1)
        if self.pairs is not None:
            hashes, lang_hash = _hashes(text.to_numpy(zero_copy_only=False)), _hashes(np.array(langs, dtype=object))
            after = np.append(ids[1:], -1)
            good = np.flatnonzero((ids >= 0) & (after >= 0))
            frequent = np.zeros(len(ids), dtype=bool)
            frequent[good] = self.pairs.holds(_mixed(hashes[ids[good]] + lang_hash[of[good]], hashes[after[good]]))
        at = np.flatnonzero(ids[:starts] >= 0)
        if 0 in self.depths:
            counts = np.bincount(of[at], minlength=len(langs))
            yield from self._nodes(pa.array(langs), pa.array([""] * len(langs)), 0, counts)
        # the key of a path is its place among the sorted paths of one word less, then its last word
        key, paths = of[at] * v + ids[at], None
        for depth in range(1, DEEPEST + 1):
            if depth > 1:
                inside = at + depth - 1 < len(ids)
                at, key = at[inside], key[inside]
                inside = ids[at + depth - 1] >= 0
                if self.pairs is not None:
                    inside &= frequent[at + depth - 2]
                at, key = at[inside], key[inside]
                key = key * v + ids[at + depth - 1]
            if not len(at) or depth > max(self.depths):
                return
            nodes, key, counts = np.unique(key, return_inverse=True, return_counts=True)
            above, last = nodes // v, pa.array(nodes % v)
            own = text.take(last)
            if depth == 1:
                lang, phrase = above, own
            else:
                lang, phrase = paths[0][above], pc.binary_join_element_wise(paths[1].take(pa.array(above)), own, " ")
            paths = lang, phrase
            if depth in self.depths:
                yield from self._nodes(pa.array(langs).take(pa.array(lang)), phrase, depth, counts)

    @staticmethod
    def _nodes(lang: pa.Array, phrase: pa.Array, depth: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(counts), 50_000):
            part = slice(k, k + 50_000)
            n = counts[part]
            yield pa.RecordBatch.from_arrays([lang[part], phrase[part], pa.array(np.full(len(n), depth, np.int32)), pa.array(n.astype(np.int64))], schema=_ARROW)


def _tries(texts: DataFrame, depths: tuple[int, ...], bits: np.ndarray | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(depths, None if bits is None else _Pairs(bits))
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                yield from shard.add(lang.as_py(), text.as_py())
        yield from shard.flush()

    return texts.mapInArrow(run, _NODES)


def _merged(tries: DataFrame, least: int) -> DataFrame:
    """Tries merged by ranges of their paths; nodes of fewer than ``least`` occurrences go, the roots stay."""
    return tries.repartitionByRange("lang", "phrase").groupBy("lang", "phrase", "depth").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("depth") == 0))


def _filter_bits(pairs: DataFrame) -> np.ndarray:
    """The filter of the rows of ``pairs(lang, phrase)``; the driver gets its words that hold a bit, not the pairs."""
    bits = FEWEST_BITS
    while bits < min(MOST_BITS, BITS_EACH * pairs.count()):
        bits *= 2
    empty = _Pairs(np.zeros(bits // 64, dtype=np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                two = batch["phrase"].str.split(" ", expand=True)
                first, second = (_hashes(two[k].to_numpy(dtype=object)) for k in (0, 1))
                slot = np.unique(empty.slots(_mixed(first + _hashes(batch["lang"].to_numpy(dtype=object)), second)))
                one = np.uint64(1) << (slot & np.uint64(63))
                at = (slot >> np.uint64(6)).astype(np.int64)
                places, start = np.unique(at, return_index=True)
                yield pd.DataFrame({"at": places, "bits": np.bitwise_or.reduceat(one, start).view(np.int64)})

    found = pairs.select("lang", "phrase").mapInPandas(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _walked(trie: DataFrame) -> DataFrame:
    """``lang, phrase, depth, f, l array<long>``: the nodes of two words or more with the occurrences of all their prefixes.

    The trie is cut in slices by a bounded sample of its paths.  What stands above the first
    node of a slice is looked up, so every slice is walked alone, one node at a time.
    """
    paths = trie.where("depth > 0").withColumn("words", F.split("phrase", " "))
    count = paths.count()
    share = max(1, -(-count // SLICES))
    cuts = sorted((r.lang, tuple(r.words)) for r in paths.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(share)) == 0).select("lang", "words").collect())
    above = sorted({(lang, " ".join(words[:n])) for lang, words in cuts for n in range(1, len(words))})
    known = {(r.lang, r.phrase): r.f for r in trie.where("depth > 0").join(F.broadcast(trie.sparkSession.createDataFrame(above, "lang string, phrase string")), ["lang", "phrase"]).collect()} if above else {}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["slice"] = [bisect_right(cuts, (lang, tuple(words))) for lang, words in zip(batch["lang"], batch["words"], strict=True)]
            yield batch

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, stack = None, []
        for batch in batches:
            left = []
            for at, lang, words, f in zip(batch["slice"], batch["lang"], batch["words"], batch["f"], strict=True):
                path = tuple(words)
                if at != here:
                    here = at
                    lang_, cut = cuts[at - 1] if at else ("", ())
                    stack = [((lang_, cut[:n]), known[lang_, " ".join(cut[:n])]) for n in range(1, len(cut))]
                while stack and (stack[-1][0][0] != lang or path[: len(stack[-1][0][1])] != stack[-1][0][1]):
                    stack.pop()
                left.append([n for _, n in stack])
                stack.append(((lang, path), f))
            batch["l"] = left
            yield batch[["lang", "phrase", "depth", "f", "l"]]

    placed = paths.mapInPandas(place, "lang string, phrase string, depth int, f long, words array<string>, slice int")
    walked = placed.repartition("slice").sortWithinPartitions("slice", "lang", "words").mapInPandas(walk, f"{_NODES}, l array<long>")
    return walked.where("depth > 1")


def _part(first: int, words: int):
    return F.array_join(F.slice(F.split("phrase", " "), first + 1, words), " ")


def mine(docs: DataFrame, *, least: int = LEAST, absorbed: int = ABSORBED, first: int = FIRST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of ``docs(lang, text)``.

    ``least`` occurrences make a phrase of two to four words a candidate; it goes if a longer
    candidate that holds it has ``absorbed`` per cent of its occurrences.  Null texts are
    empty, a null language is ``und``, as is a language of that name.  Repeated rows count
    each.  Equal scores go by occurrences, then by the phrase's bytes.  Other columns are
    ignored; empty tables and tables without candidates give no rows.
    """
    texts = in_small_batches(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    short = stash(_merged(stash(_tries(texts, (0, 1, 2))), least))
    bits = _filter_bits(short.where("depth = 2"))
    long = stash(_merged(stash(_tries(texts, (3, 4), bits)), least))
    trie = short.unionByName(long)
    nodes = stash(_walked(trie))
    links = nodes.select("lang", "phrase", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k")).withColumn("suffix", F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, DEEPEST), " "))
    links = stash(links)
    parts = trie.where("depth > 0").select("lang", F.col("phrase").alias("suffix"), F.col("f").alias("right")).join(links.groupBy("lang", "suffix").agg(F.count(F.lit(1)).alias("_n")), ["lang", "suffix"])
    right = join_hot(links, stash(parts), ["suffix", "lang"], "_n", "phrase").groupBy("lang", "phrase").agg(F.map_from_entries(F.collect_list(F.struct("k", "right"))).alias("r"))
    inner = F.array(*(F.when(F.col("depth") >= d, _part(s, w)) for d, w in ((3, 2), (4, 3), (4, 2)) for s in range(d - w + 1)))
    longer = nodes.where("depth > 2").select("lang", F.explode(F.array_distinct(F.filter(inner, lambda p: p.isNotNull()))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    cut = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda k: F.struct(F.element_at("l", k).alias("l"), F.element_at("r", k).alias("r"), k.alias("k")))
    score = lambda c: F.struct(F.call_function("div", F.col("f").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), c["l"].cast("decimal(20,0)") + c["r"].cast("decimal(20,0)")).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))
    scored = (
        nodes.join(right, ["lang", "phrase"])
        .join(longer, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < absorbed * F.col("f").cast("decimal(20,0)")))
        .withColumn("best", F.array_min(F.transform(cut, score)))
        .select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    words = trie.where("depth = 0").select("lang", F.col("f").alias("n"))
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def twin(least: int = LEAST, absorbed: int = ABSORBED, first: int = FIRST) -> str:
    """DuckDB SQL for ``mine`` over ``documents``: every phrase is listed and counted."""
    return rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), counts AS MATERIALIZED (
  SELECT lang, k AS depth, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM pieces, unnest(range(1, 5)) t(k), unnest(range(1, len(w) - k + 2)) u(i)) GROUP BY ALL
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, phrase, depth, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE depth > 1 AND f >= {least}),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:depth], ' ') AS rest FROM candidates, unnest(range(1, depth)) t(k)
), cuts AS (
  SELECT p.lang, p.phrase, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM parts p JOIN counts l ON l.lang = p.lang AND l.phrase = p.head JOIN counts r ON r.lang = p.lang AND r.phrase = p.rest
  QUALIFY row_number() OVER (PARTITION BY p.lang, p.phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS f
  FROM candidates, unnest(range(2, 4)) t(k), unnest(range(1, depth - k + 2)) u(i) WHERE k < depth GROUP BY ALL
)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, n, score
FROM cuts c JOIN totals USING (lang) LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase
WHERE g.f IS NULL OR 100 * g.f < {absorbed} * a QUALIFY rank <= {first}
"""


TWIN = twin()
