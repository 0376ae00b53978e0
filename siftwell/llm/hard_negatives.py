"""Hard-negative mining by norm-bucketed search (operator 12).

Rows are sorted by norm and cut into buckets; a span is a run of buckets that one task
searches for one block of queries.  By Cauchy-Schwarz no row scores more than the query's
norm times the largest norm of its bucket, so a pair of block and span whose bound misses
every lower limit is never formed, and inside a span a query stops at the first bucket that
can reach neither its window's lower limit nor its running kth score.  The span of largest
norms is searched first; the kth scores found there are limits for all others.

Two such searches: the nearest rows of a query's own label (spans and blocks by label), then,
for each of these positives, the best rows of other labels inside the positive's window.
Both are exact: scores are integers, ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm._shared import in_order, join_hot, stash

MOST = 5
#: Rows of a bucket, buckets of a span, queries of a block.
BUCKET, SPAN, BLOCK = 1_024, 8, 512
#: Rows whose squared norm is larger take no part: their scores need not fit in 64 bits.
LARGEST = float(2**62)
_LOW, _HIGH = -(2**63), 2**63 - 1


def prepared(vectors: DataFrame, *, every: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """``vec_id, label, v, norm``: labels moved on, components to whole numbers; rows that take no part are gone, equal rows are one."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))
    number = F.col("vec_id").cast("long")
    label = F.when(F.pmod(number, F.lit(every)) == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(labels))).otherwise(F.col("label").cast("long")).cast("int")
    rows = vectors.where(there).select(number.alias("vec_id"), label.alias("label"), F.transform(e, lambda x: F.floor(x * scale).cast("double")).alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    return rows.where(F.col("norm") < float(np.sqrt(LARGEST))).groupBy("vec_id", "label", "v").agg(F.first("norm").alias("norm"))


def _grouped(df: DataFrame, keys: list[str], order: list[Column], size: int, name: str, ident: str) -> DataFrame:
    """``df`` with ``name``: runs of ``size`` rows in order within ``keys``, or in all, whatever the partitions; a run is named by a number."""
    numbered = in_order(df, [*map(F.col, keys), *order], {"_number": F.lit(1).cast("long")})
    number = F.col("_number")
    if not keys:
        return stash(numbered.withColumn(name, F.floor(number / size)).drop("_number"))
    numbered = stash(numbered)
    firsts = stash(numbered.groupBy(*keys).agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    placed = join_hot(numbered, firsts, keys, "_rows", ident)
    return stash(placed.withColumn(name, F.col("_first") + F.floor((number - F.col("_first")) / size) * size).drop("_number", "_first", "_rows"))


def _bucketed(rows: DataFrame, keys: list[str], span_rows: int) -> DataFrame:
    """``rows`` with ``span``: sorted by norm and cut; a span never holds two keys or more than ``span_rows`` rows."""
    return _grouped(rows, keys, [F.desc("norm"), F.col("vec_id"), F.xxhash64("v")], span_rows, "span", "vec_id")


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones go on with zeros."""
    out = np.zeros((len(column), width))
    for n, v in enumerate(column):
        out[n, : len(v)] = v
    return out


def _scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products: sums of this size are whole numbers in double precision, larger ones take 64-bit integers."""
    if largest < 2**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(scores: np.ndarray, may: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``most`` highest scores where ``may`` holds and their ids; columns stand in the order of the ids.  Free places hold ``_LOW`` and ``_HIGH``."""
    rows, width = scores.shape
    size = 1 << int(width).bit_length()
    if np.abs(scores, where=may, out=np.zeros_like(scores)).max(initial=0) >= 2**62 // size:  # ranks in place of scores that leave no room for the column
        values, scores = np.unique(scores, return_inverse=True)
        scores = scores.reshape(rows, width)
    else:
        values = None
    key = np.where(may, scores * size + (size - 1 - np.arange(width)), _LOW)
    take = min(most, width)
    top = np.partition(key, width - take, axis=1)[:, width - take :] if take < width else key
    found = top != _LOW
    score = np.where(found, top >> (size.bit_length() - 1), 0)
    column = np.where(found, size - 1 - (top & (size - 1)), 0)
    if values is not None:
        score = values[score]
    return np.where(found, score, _LOW), np.where(found, ids[column], _HIGH)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    order = np.lexsort((ids, -np.maximum(score, _LOW + 1)), axis=1)[:, :most]
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)


def search_span(queries: pd.DataFrame, rows: pd.DataFrame, *, same: bool, most: int, bucket: int) -> tuple[pd.DataFrame, int]:
    """Best rows of a span for ``queries(query, own, label, v, norm, low, high)``, and how many scores were reckoned.

    ``low`` and ``high`` bound the scores that count; ``same`` asks for rows of the query's
    label, itself (``own``) left out, else for rows of other labels.
    """
    rows = rows.sort_values(["norm", "vec_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    width = max(map(len, [*queries["v"], *rows["v"]]), default=0)
    # the windows of one vector share its scores
    first, inverse = np.unique(queries["own"].to_numpy(), return_index=True, return_inverse=True)[1:]
    a, b = _matrix(queries["v"].iloc[first], width), _matrix(rows["v"], width)
    norm, low, high = (queries[c].to_numpy() for c in ("norm", "low", "high"))
    label, own, row_label, row_norm, ids = queries["label"].to_numpy(), queries["own"].to_numpy(), rows["label"].to_numpy(), rows["norm"].to_numpy(), rows["vec_id"].to_numpy()
    best = np.full((len(queries), most), _LOW), np.full((len(queries), most), _HIGH)
    reckoned = 0
    for start in range(0, len(rows), bucket):
        part = np.arange(start, min(start + bucket, len(rows)))
        bound = norm * row_norm[start] * (1 + 1e-9) + 1
        alive = np.flatnonzero((bound >= low) & (bound >= best[0][:, -1]))
        if not len(alive):
            break
        part = part[np.argsort(ids[part], kind="stable")]
        vectors, at = np.unique(inverse[alive], return_inverse=True)
        scores = _scores(a[vectors], b[part], norm.max() * row_norm[start])
        reckoned += scores.size
        for block in np.array_split(np.arange(len(alive)), -(-len(alive) // 512)):
            q = alive[block]
            s = scores[at[block]]
            alike = label[q][:, None] == row_label[part][None, :]
            may = (alike & (own[q][:, None] != ids[part][None, :])) if same else ~alike
            may &= (s >= low[q][:, None]) & (s <= high[q][:, None]) & (s >= best[0][q, -1:])
            some = may.any(axis=1)
            if some.any():
                q = q[some]
                best[0][q], best[1][q] = _merged((best[0][q], best[1][q]), _best(s[some], may[some], ids[part], most), most)
    n, k = np.nonzero(best[0] != _LOW)
    return pd.DataFrame({"query": queries["query"].to_numpy()[n], "found": best[1][n, k], "score": best[0][n, k]}), reckoned


def _searched(queries: DataFrame, rows: DataFrame, pairs: DataFrame, *, same: bool, most: int, bucket: int) -> DataFrame:
    """``query, found, score`` of every pair of block and span; each pair is a group of bounded size."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": np.empty(0, np.int64), "found": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        return search_span(a, b, same=same, most=most, bucket=bucket)[0]

    named = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731 - both sides hold columns of ``pairs``
    pairs = pairs.select(F.col("block").cast("long").alias("block"), F.col("span").cast("long").alias("span"))  # equal types: both sides are dealt by them
    left, right = named(queries.join(named(pairs), "block")), named(rows.join(named(pairs), "span"))
    return left.groupBy("block", "span").cogroup(right.groupBy("block", "span")).applyInPandas(run, "query long, found long, score long")


def _first(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each query, with their rank from 1; every span has reported ``most`` at most."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _nearest(queries: DataFrame, rows: DataFrame, keys: list[str], *, same: bool, most: int, bucket: int, span: int, block: int) -> DataFrame:
    """``query, found, score, rank``: the exact best ``most`` rows for ``queries(query, own, label, v, norm, low, high)``.

    The first search takes the leading span of each key, the second all the others whose bound
    reaches the limits that the first has left.
    """
    spans = stash(rows.groupBy("span", *keys).agg(F.max("norm").alias("_longest")))
    # names of spans grow as their norms fall
    leading = spans.groupBy(*keys).agg(F.min("span").alias("span"))
    dealt = _blocks(queries, keys, block)
    ahead = dealt.select("block", *keys).distinct()
    ahead = ahead.join(leading, keys) if keys else ahead.withColumn("span", F.lit(0).cast("long"))
    early = stash(_searched(dealt, rows, stash(ahead.select("block", "span")), same=same, most=most, bucket=bucket))
    kth = _first(early, most).where(F.col("rank") == most).select("query", F.col("score").alias("_kth"))
    limited = stash(dealt.join(kth, "query", "left").withColumn("low", F.greatest("low", F.coalesce("_kth", F.lit(_LOW)))).drop("_kth"))
    blocks = limited.groupBy("block", *keys).agg(F.max("norm").alias("_norm"), F.min("low").alias("_low"))
    # blocks meet spans, not rows: a row here stands for millions of scores
    if keys:
        pairs = blocks.join(spans.join(leading.select("span"), "span", "left_anti"), keys)
    else:
        last = blocks.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]
        pairs = spans.where("span > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")) if last >= 0 else F.array().cast("array<bigint>"))).join(blocks, "block")
    pairs = pairs.where(F.col("_norm") * F.col("_longest") * (1 + 1e-9) + 1 >= F.col("_low"))
    late = _searched(limited, rows, stash(pairs.select("block", "span")), same=same, most=most, bucket=bucket)
    return _first(early.unionByName(late), most)


def _blocks(queries: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``queries`` with ``block``: those that need rows of like norms go together, so that a block's bound is near that of each."""
    need = F.coalesce(F.col("low") / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0))
    return _grouped(queries.withColumn("_need", need), keys, [F.col("_need"), F.col("own"), F.col("query")], block, "block", "query").drop("_need")


def _query(own: Column, label: Column, low: Column, high: Column) -> list[Column]:
    return [F.monotonically_increasing_id().alias("query"), own.alias("own"), label.alias("label"), F.col("v"), F.col("norm"), low.cast("long").alias("low"), high.cast("long").alias("high")]


def mine(vectors: DataFrame, *, anchors: int = 100, positives: int = MOST, negatives: int = MOST, least_share: int = 80, bucket: int = BUCKET, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vectors(vec_id, embedding, label)``.

    Anchors are the rows whose id ``anchors`` divides.  A positive's negatives are the best rows of
    other labels that score at least ``least_share`` per cent of it and no more than it.  Rows
    take no part whose id, label or vector is null, that hold a null or non-finite component,
    or whose whole-number components have a squared norm of 2^62 or more.  Shorter vectors
    go on with zeros, an empty one scores 0 with all.  Equal rows count once; rows that share
    an id but differ are rows of their own, though none is a positive of its own id.  Other
    columns are ignored; an empty table, a label with one row or an empty window gives no rows.
    """
    rows = stash(prepared(vectors))
    asked = stash(rows.where(F.pmod("vec_id", F.lit(anchors)) == 0).select(*_query(F.col("vec_id"), F.col("label"), F.lit(_LOW), F.lit(_HIGH))))
    options = {"bucket": bucket, "span": span, "block": block}
    near = stash(_nearest(asked, _bucketed(rows, ["label"], bucket * span), ["label"], same=True, most=positives, **options))
    share = F.ceil(F.col("positive_score").cast("decimal(30,0)") * least_share / 100).cast("long")
    windows = near.where("score >= 0").select("query", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")).join(asked.drop("low", "high"), "query")
    windows = stash(windows.select(*_query(F.col("own"), F.col("label"), share, F.col("positive_score")), "positive_id", "positive_score"))
    far = _nearest(windows.drop("positive_id", "positive_score"), _bucketed(rows, [], bucket * span), [], same=False, most=negatives, **options)
    named = windows.select("query", F.col("own").alias("anchor_id"), "positive_id", "positive_score")
    return far.join(named, "query").select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


TWIN = """
WITH fine AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS alike, r.vec_id AS other_id, list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM fine a, fine r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE alike AND other_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
