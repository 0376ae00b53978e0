"""Numbers and sums in a total order, without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices that the range of the first order column is cut into.
SLICES = 256


def _cuts(df: DataFrame, first: str, slices: int) -> list:
    """Quantiles of a column: at most ``slices - 1`` values on the driver."""
    found = df.agg(F.percentile_approx(first, [n / slices for n in range(1, slices)], 10_000).alias("q")).first().q
    return sorted(set(found or []))


def summed_before(df: DataFrame, order: Sequence[str], name: str, keys: Sequence[str] = (), weight: Column | None = None, *, slices: int = SLICES) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (or the number) of the rows before, within each combination of ``keys`` if there are any.

    ``order`` has to tell all rows apart; its first column is a number, a date or a
    timestamp.  The column's range is cut at its quantiles; rows are summed within a
    slice, and the sums of the slices before it are added, so neither the whole table
    nor a key with very many rows is one task's sort, unless they tie in that column.
    The cuts are constants of the plan: a task that runs again gives the same numbers.
    Null keys form a group of their own; nulls in the first order column come first.
    """
    weight = F.lit(1) if weight is None else weight
    cuts = _cuts(df, order[0], slices)
    own, groups = F.col(order[0]), [F.col(k) for k in keys]
    at = F.array(*map(F.lit, cuts)).cast(f"array<{df.schema[order[0]].dataType.simpleString()}>")
    passed = F.size(F.filter(at, lambda c: c <= own)) if cuts else F.lit(0)
    placed = df.withColumns({"_slice": F.when(own.isNull(), F.lit(-1)).otherwise(passed), "_weight": weight.cast("long")})
    before = lambda column, *parts: Window.partitionBy(*groups, *parts).orderBy(*column).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*groups, "_slice").agg(F.sum("_weight").alias("_n"))
    starts = sizes.select(*(c.alias(f"_k{n}") for n, c in enumerate(groups)), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before(["_slice"])), F.lit(0)).alias("_start"))
    same = F.col("_slice") == F.col("_s")
    for n, c in enumerate(groups):
        same = same & c.eqNullSafe(F.col(f"_k{n}"))
    within = F.coalesce(F.sum("_weight").over(before(order, "_slice")), F.lit(0))
    return placed.withColumn("_within", within).join(starts, same).select(*df.columns, (F.col("_start") + F.col("_within")).alias(name))


def numbered(df: DataFrame, order: Sequence[str], name: str, keys: Sequence[str] = (), *, slices: int = SLICES) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... by ``order``; see :func:`summed_before`."""
    return summed_before(df, order, name, keys, slices=slices)
