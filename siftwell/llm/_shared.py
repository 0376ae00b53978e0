"""Helpers shared by the operators: durable intermediate tables, bounded bucket
joins, connected components.

Executors may vanish at any time, so lineage is cut only by writing a table to
the folder in ``spark.checkpoint.dir``; nothing is kept in executor-local files.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []

#: A-Z to a-z and nothing else, the folding all the contracts ask for.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on a single local machine without one, a temporary folder."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="siftwell-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps see a plain, replayable table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/siftwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(sweep)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a stashed frame that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        name = path.rsplit("/", 1)[-1]
        if name.startswith("siftwell-"):
            _delete(df.sparkSession, path)
            _WRITTEN[:] = [w for w in _WRITTEN if not w[1].endswith(name)]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep() -> None:
    """Delete every table this process stashed (also runs when the driver ends)."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


#: Rows that go to Python in one Arrow batch at most: texts have no bound, so batches of them need one.
BATCH_ROWS = 1_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's rows per Arrow batch to ``BATCH_ROWS`` where it is higher.

    The setting is read when a plan runs, so it has to stay lowered; rows per batch change no result.
    """
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df


# --------------------------------------------------------------------- groups


def contiguous_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut a stream that is sorted by ``keys`` into frames that hold whole groups.

    A group that straddles two batches is carried over, so memory follows the
    largest group (which callers bound), not the partition.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and (batch[keys].iloc[-1] == held[-1][keys].iloc[-1]).all():
            held.append(batch)
            continue
        last = batch[keys].iloc[-1]
        same = np.ones(len(batch), dtype=bool)
        for k in keys:
            same &= (batch[k] == last[k]).to_numpy()
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        done = [*held, batch.iloc[:start]]
        held = [batch.iloc[start:]]
        done = [x for x in done if len(x)]
        if done:
            yield pd.concat(done, ignore_index=True)
    if held:
        yield pd.concat(held, ignore_index=True)


def group_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Offsets of the groups of a sorted frame, with its length at the end."""
    change = np.zeros(len(frame), dtype=bool)
    change[0] = True
    for k in keys:
        v = frame[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(frame))


def small_pairs(cuts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs inside the groups of at most ``most`` rows, all groups at once, one distance after another."""
    sizes = np.diff(cuts)
    ends = np.repeat(np.where(sizes <= most, cuts[1:], 0), sizes)
    rows = np.flatnonzero(ends > np.arange(len(ends)) + 1)
    step = 1
    while len(rows):
        yield rows, rows + step
        step += 1
        rows = rows[rows + step < ends[rows]]


def large_groups(cuts: np.ndarray, most: int) -> list[tuple[int, int]]:
    big = np.flatnonzero(np.diff(cuts) > most)
    return [(int(cuts[k]), int(cuts[k + 1])) for k in big]


#: Keys that ``join_hot`` names at most, and rows of a key that one task takes in any case.
HOT_KEYS, COOL = 1_000, 1_024


def join_hot(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, ident: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row that ``per_key`` has for each of ``keys``; no key is a hot task.

    ``count`` (a column of ``per_key``) says how many rows a key has.  Keys with more than a
    ``HOT_KEYS``-th of all, which are fewer than ``HOT_KEYS``, are salted by a hash of
    ``ident`` and named in the plan (by the first of ``keys``); their row in ``per_key`` is
    repeated for each salt.  The plan is the same whether there are any or not.
    """
    total, largest = per_key.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    share = max(COOL, -(-total // HOT_KEYS))
    hot = [r[0] for r in per_key.where(F.col(count) > share).select(keys[0]).distinct().collect()] if largest > share else []
    spread = F.when(F.col(keys[0]).isin(hot), -(-largest // share)).otherwise(1)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(ident), spread))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), spread.cast("long") - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def in_order(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name, the sum of its column over the rows before; ``order`` has to tell rows apart.

    Rows are dealt by ranges of the order, summed in each, and the sums of the ranges before are added.
    """
    placed = stash(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    ranges = placed.groupBy("_p").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_range = before(Window.partitionBy(F.lit(0)).orderBy("_p"))
    starts = ranges.select("_p", *(F.coalesce(F.sum(f"_sum_{n}").over(by_range), F.lit(0)).alias(f"_start_{n}") for n in sums))
    own = before(Window.partitionBy("_p").orderBy(*order))
    return placed.withColumns({f"_own_{n}": F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()}).join(starts, "_p").select(*df.columns, *((F.col(f"_own_{n}") + F.col(f"_start_{n}")).alias(n) for n in sums))


def plainly_named(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` and, for all other columns, names by their place, as Arrow functions and schemas read names with dots or quotes otherwise; ``toDF`` gives the names back."""
    return df.toDF(*("text" if c == "text" else f"_{k}" for k, c in enumerate(df.columns)))


def bucket_join(rows: DataFrame, within: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str, *, key: str, ident: str, most: int, payload: DataFrame | None = None) -> DataFrame:
    """Compare the rows that share ``key`` without ever holding an unbounded bucket.

    Buckets of one row are dropped.  A bucket of more than ``most`` rows is dealt by
    a hash of ``ident`` into chunks of about ``most`` rows, and every pair of chunks
    becomes a task group of its own, so each pair of rows still meets.
    ``within(frame, cuts, side)`` sees whole groups (row offsets in ``cuts``); rows of
    a group compare only where their ``side`` differs (the second chunk has side 1), or
    with all others where the group has but one side (-1: a chunk that meets itself).
    ``payload`` (one row for each ``ident``) is attached to rows of shared buckets only.
    """
    crowd = stash(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    dealt = (
        join_hot(rows, crowd, [key], "_n", ident)
        .withColumn("_c", F.ceil(F.col("_n") / F.lit(most)).cast("int"))
        .withColumn("_s", F.pmod(F.xxhash64(ident), F.col("_c")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
        .withColumn("_i", F.least("_s", "_o"))
        .withColumn("_j", F.greatest("_s", "_o"))
        .drop("_n", "_c", "_o")
    )
    if payload is not None:
        dealt = dealt.join(payload, ident)
    keys = [key, "_i", "_j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in contiguous_groups(batches, keys):
            first = frame["_i"].to_numpy()
            side = np.where(first == frame["_j"].to_numpy(), -1, frame["_s"].to_numpy() != first).astype(np.int8)
            made = within(frame, group_starts(frame, keys), side)
            if len(made):
                yield made

    return dealt.repartition(*keys).sortWithinPartitions(*keys, ident).mapInPandas(run, schema)


def may_meet(side: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows of one group are to be compared."""
    return (side[i] < 0) | (side[i] != side[j])


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union the linked positions; ``labels`` always holds the smallest position of each class."""
    while True:
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return labels
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up


# ----------------------------------------------------------------- components


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(src, dst)``: ``(node, component)``, the smallest id reachable.

    Alternates large-star and small-star steps; each round is written to the shared
    folder, so losing executors costs one round at most.  Nodes without an edge to
    another node don't appear.  Hot nodes: each step is a partial aggregate plus a
    join whose two sides are plain exchanges, which adaptive execution may split.
    """
    links = stash(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    last = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large)
        low2 = stash(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stash(small)
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (links, low, large, low2):
            discard(old)
        links = after
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
