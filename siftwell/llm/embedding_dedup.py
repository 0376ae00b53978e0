"""Near-duplicate vectors by cross-polytope hashing (operator 7).

A hash rotates a vector by three rounds of random signs and a fast Hadamard
transform and takes the nearest vertex of the cross-polytope (largest coordinate and
its sign).  A table concatenates as many hashes as the number of vectors asks for;
a vector also enters the buckets of its next-nearest vertices (multiprobe).  How
many tables it takes to find a pair at the threshold is estimated beforehand on
random pairs at exactly that cosine.  Candidates are verified by cosine in double
precision inside their bucket; a bucket reports counts and class edges, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import bucket_join, components, join_hot, large_groups, may_meet, merge_labels, small_pairs, stash

LEAST = 0.9
#: Estimated share of the pairs at the threshold that the tables find.
RECALL = 0.985
BUCKET = 8_192
SMALL = 48


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


@dataclass(frozen=True)
class Hashing:
    size: int  # of the vectors
    hashes: int  # concatenated in a table
    tables: int
    probes: int  # buckets beside its own that a vector enters in each table
    seed: int = 11

    @cached_property
    def width(self) -> int:
        return 1 << max(2, (self.size - 1).bit_length())

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Bucket keys of unit rows: ``(rows, tables, 1 + probes)``, the own bucket first."""
        rng = np.random.default_rng(self.seed)
        n, w = len(x), self.width
        padded = np.zeros((n, w))
        padded[:, : self.size] = x
        out = np.empty((n, self.tables, 1 + self.probes), dtype=np.int64)
        for t in range(self.tables):
            codes, loss = [], []
            for _ in range(self.hashes):
                y = padded
                for _ in range(3):
                    y = hadamard(y * rng.choice([-1.0, 1.0], size=w))
                top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
                value = np.take_along_axis(y, top, axis=1)
                codes.append(2 * top + (value < 0))
                loss.append((np.abs(value[:, :1]) - np.abs(value))[:, 1:])
            base = np.array([(2 * w) ** k for k in range(self.hashes)], dtype=np.int64)
            own = sum(c[:, 0] * b for c, b in zip(codes, base, strict=True))
            # one hash at a time moves to its second or third vertex; the least loss goes first
            moved = np.concatenate([own[:, None] + (c[:, 1:] - c[:, :1]) * b for c, b in zip(codes, base, strict=True)], axis=1)
            order = np.argsort(np.concatenate(loss, axis=1), axis=1, kind="stable")[:, : self.probes]
            out[:, t, 0] = own
            out[:, t, 1:] = np.take_along_axis(moved, order, axis=1)
            out[:, t] = out[:, t] * self.tables + t
        return out


def plan_hashing(size: int, count: int, least: float = LEAST, recall: float = RECALL) -> Hashing:
    """Hashes a table by the number of vectors, tables by the chance that a pair at the threshold meets in one."""
    width = 1 << max(2, (size - 1).bit_length())
    hashes = 2
    while (2 * width) ** hashes < 4 * count and (2 * width) ** (hashes + 1) < 1 << 56:
        hashes += 1
    probes = min(2 * hashes, 6)
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((2, 400, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if size > 1:
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = least * a + np.sqrt(1 - least**2) * b
    else:
        b = a
    trial = Hashing(size, hashes, 48, probes)
    meet = (trial.keys(a)[:, :, :, None] == trial.keys(b)[:, :, None, :]).any(axis=(2, 3))
    # pairs differ in how easily they meet, so the estimate is made per pair
    chance = np.clip(meet.mean(axis=1), 0.001, 0.999)
    tables = 1
    while (1 - (1 - chance) ** tables).mean() < recall:
        tables += 1
    return Hashing(size, hashes, tables, probes)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embedding: str = "embedding"):
    """Vectors that can link: no null or non-finite component, and not all zero."""
    e = F.col(embedding)
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & fine & F.exists(e, lambda v: v != 0), F.lit(False))


def _first_meeting(keys: np.ndarray, table: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether each pair shares no bucket before this one, so that it is counted once."""
    alive = np.arange(len(i))
    for t in range(keys.shape[1]):
        open_ = alive[table[i[alive]] >= t]
        if not len(open_):
            break
        a, b = keys[i[open_], t], keys[j[open_], t]
        same = a[:, :, None] == b[:, None, :]
        shared = np.where(same, a[:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
        before = np.where(table[i[open_]] == t, shared < key[i[open_]], same.any(axis=(1, 2)))
        alive = np.setdiff1d(alive, open_[before], assume_unique=True)
    out = np.zeros(len(i), dtype=bool)
    out[alive] = True
    return out


def _compare(hashing: Hashing, least: float):
    def within(frame: pd.DataFrame, cuts: np.ndarray, side: np.ndarray) -> pd.DataFrame:
        x, rep, n = _unit(frame["embedding"]), frame["rep"].to_numpy(), frame["n"].to_numpy()
        keys = np.stack(frame["keys"].to_numpy()).reshape(len(frame), hashing.tables, -1)
        key = frame["bucket"].to_numpy()
        table = key % hashing.tables
        label, links = np.arange(len(frame)), np.zeros(len(frame), dtype=np.int64)

        def take(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal label
            label = merge_labels(label, i, j)
            once = _first_meeting(keys, table, key, i, j)
            np.add.at(links, i[once], n[j[once]])
            np.add.at(links, j[once], n[i[once]])

        for i, j in small_pairs(cuts, SMALL):
            near = ((x[i] * x[j]).sum(axis=1) >= least) & may_meet(side, i, j)
            if near.any():
                take(i[near], j[near])
        for a, b in large_groups(cuts, SMALL):
            for k in range(a, b, 64):
                i, j = np.nonzero(x[k : min(k + 64, b)] @ x[a:b].T >= least)
                i, j = i + k, j + a
                keep = (i < j) & may_meet(side, i, j)
                if keep.any():
                    take(i[keep], j[keep])
        other, some = label != np.arange(len(frame)), links > 0
        return pd.DataFrame({"src": np.concatenate([rep[label[other]], rep[some]]), "dst": np.concatenate([rep[other], rep[some]]), "links": np.concatenate([np.zeros(other.sum(), np.int64), links[some]])})

    return within


def near_vectors(vectors: DataFrame, *, least: float = LEAST) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing; vectors of different lengths never link.  Equal vectors are one class: they
    are compared once and count as many links.  Rows that repeat a vec_id are vectors of
    their own.  Other columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = rows.where(usable())
    distinct = stash(fine.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("rep is not null"))
    parts = []
    for r in distinct.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect():
        parts.append(_links_of(distinct.where(F.size("embedding") == r["size"]), plan_hashing(r["size"], r["n"], least), least))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = stash(found)
    linked = found.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("others"))
    named = components(found.where("src <> dst").select("src", "dst"))
    classes = stash(
        distinct.join(linked, "rep", "left")
        .join(named.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.xxhash64("embedding").alias("_hash"), "embedding", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = join_hot(rows.withColumn("_hash", F.xxhash64("embedding")), classes, ["_hash", "embedding"], "n", "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links_of(distinct: DataFrame, hashing: Hashing, least: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                k = hashing.keys(_unit(batch["embedding"]))
                yield pd.DataFrame({"rep": batch["rep"], "n": batch["n"], "embedding": batch["embedding"], "keys": list(k.reshape(len(batch), -1))})

    hashed = stash(distinct.select("rep", "n", "embedding").mapInPandas(run, "rep long, n long, embedding array<double>, keys array<long>"))
    return bucket_join(hashed.select("rep", F.explode("keys").alias("bucket")), _compare(hashing, least), "src long, dst long, links long", key="bucket", ident="rep", most=BUCKET, payload=hashed)
