"""Ranking and running totals that no single task has to carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Number of slices that the key range of every group is cut into.
SLICES = 4096


def unit_key(*cols: Column, seed: int = 0) -> Column:
    """A reproducible pseudo-random DOUBLE in [0, 1) of the given columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def _slice(key: str, slices: int) -> Column:
    return F.least(F.floor(F.col(key) * slices), F.lit(slices - 1)).cast("int")


def running_totals(
    df: DataFrame, groups: list[str], key: str, tie: list[str], value: Column, out: str, slices: int = SLICES
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of the group that stand before the row.

    Rows stand in the order of ``key`` (a DOUBLE in [0, 1)) and then of ``tie``. The key range is cut
    into slices: per-slice sums are added up over at most ``slices`` rows per group, and only rows of
    one slice are sorted together, so a group with a third of all rows is no hot task. Null group
    values form a group of their own; null values count 0.
    """
    d = df.withColumn("_v", F.coalesce(value, F.lit(0)).cast("double")).withColumn("_s", _slice(key, slices))
    sums = d.groupBy(*groups, "_s").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*groups).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_s").alias("_s2"), F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_b"))
    cond = F.col("_s") == F.col("_s2")
    for i, g in enumerate(groups):
        cond &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    d = d.join(sums, cond, "left")
    inside = Window.partitionBy(*groups, "_s").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn(out, F.col("_b") + F.coalesce(F.sum("_v").over(inside), F.lit(0.0))).drop("_v", "_s", "_s2", "_b", *[f"_g{i}" for i in range(len(groups))])


def smallest_keys(df: DataFrame, groups: list[str], key: str, tie: list[str], quota: str, slices: int = SLICES) -> DataFrame:
    """The ``quota`` rows (a column, equal within a group) of every group with the smallest keys.

    Exact: all rows of the slices below the boundary slice are taken without ranking, and only the
    boundary slice is ranked. Groups with a null or non-positive quota give no rows.
    """
    d = df.where(F.col(quota) > 0).withColumn("_s", _slice(key, slices))
    counts = d.groupBy(*groups, "_s").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_s").alias("_s2"), "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_b"))
    cond = F.col("_s") == F.col("_s2")
    for i, g in enumerate(groups):
        cond &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    d = d.join(counts, cond).where(F.col("_b") < F.col(quota))
    sure = d.where(F.col("_b") + F.col("_n") <= F.col(quota))
    edge = d.where(F.col("_b") + F.col("_n") > F.col(quota)).withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_s").orderBy(key, *tie)))
    edge = edge.where(F.col("_b") + F.col("_r") <= F.col(quota)).drop("_r")
    return sure.unionByName(edge).drop("_s", "_s2", "_n", "_b", *[f"_g{i}" for i in range(len(groups))])
