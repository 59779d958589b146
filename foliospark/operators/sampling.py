"""Proportional quotas over strata and reproducible samples within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.scale import running_totals, smallest_keys, unit_key


def allocate(sizes: DataFrame, n: int, name: str) -> DataFrame:
    """Adds ``quota`` to strata (``name``, size): shares of ``n`` by largest remainder, never above the size.

    The sum is the smaller of ``n`` and all rows. Ties between remainders fall to the smaller name. One
    pass is enough: the units left over are fewer than the strata with a remainder. The strata are few.
    """
    every = Window.partitionBy()
    d = sizes.withColumn("_total", F.sum("size").over(every)).withColumn("_n", F.least(F.lit(max(n, 0)), F.col("_total")))
    d = d.withColumn("_exact", F.when(F.col("_total") > 0, F.col("_n") * F.col("size") / F.col("_total").cast("double")).otherwise(0.0))
    d = d.withColumn("_base", F.least(F.floor("_exact"), F.col("size")))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.floor("_exact")), name))
    left = F.col("_n") - F.sum("_base").over(every)
    return d.withColumn("quota", (F.col("_base") + (rank <= left).cast("long")).cast("long")).drop("_total", "_n", "_exact", "_base")


def queues(rows: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """Adds ``place``: the place of each row in its stratum's random order, whatever the order of the input.

    The order is that of a SHA-256 of seed and key; its first digits cut each stratum into slices, so that
    a large stratum is ranked in many tasks.
    """
    d = rows.withColumn("_sha", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256))
    d = d.withColumn("_u", F.conv(F.substring("_sha", 1, 12), 16, 10).cast("double") / F.lit(float(16**12)))
    return running_totals(d, strata, "_u", ["_sha", key], F.lit(1), "_before").withColumn("place", (F.col("_before") + 1).cast("int")).drop("_sha", "_u", "_before")


def draw(rows: DataFrame, strata: list[str], key: str, n: int, seed: int, have: DataFrame | None = None) -> DataFrame:
    """``n`` rows over all strata in proportion to their size, less what ``have`` (strata, had) already holds.

    Only the slice of keys at the quota's edge is ranked in each stratum, so a large stratum is no hot task.
    """
    name = F.to_json(F.struct(*strata), {"ignoreNullFields": "false"})
    keyed = rows.withColumn("_stratum", name)
    sizes = keyed.groupBy("_stratum").agg(F.count(F.lit(1)).alias("size"))
    q = allocate(sizes, n, "_stratum")
    if have is not None:
        had = have.withColumn("_stratum", name).groupBy("_stratum").agg(F.sum("had").alias("_had"))
        q = q.join(had, "_stratum", "left").withColumn("quota", F.greatest(F.lit(0), F.col("quota") - F.coalesce("_had", F.lit(0))))
    d = keyed.join(q.select("_stratum", "quota"), "_stratum").withColumn("_u", unit_key(F.col(key), seed=seed))
    return smallest_keys(d, ["_stratum"], "_u", [key], "quota").drop("_stratum", "_u", "quota")


def missing(quotas: DataFrame, drawn: DataFrame, strata: list[str]) -> DataFrame:
    """(strata, missing): how many rows each stratum is short of its quota; full strata are left out."""
    n = drawn.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    cond = [F.col(f"q.{s}").eqNullSafe(F.col(f"n.{s}")) for s in strata]
    j = quotas.alias("q").join(n.alias("n"), cond, "left")
    return j.select(*[F.col(f"q.{s}").alias(s) for s in strata], (F.col("quota") - F.coalesce("_n", F.lit(0))).alias("missing")).where("missing > 0")


def running_stop(rows: DataFrame, order: str, cost: str, cap: float, group: str | None = None) -> DataFrame:
    """The rows before the first one at which the running sum of ``cost`` would pass ``cap``, with the sum ``spent``.

    Within ``group``; without one the order is global, which one task has to carry: use it on logs.
    """
    w = (Window.partitionBy(group) if group else Window).orderBy(order)
    spent = F.sum(F.coalesce(F.col(cost), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = rows.withColumn("spent", spent)
    return d.withColumn("_broken", F.max((F.col("spent") > cap).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_broken = 0").drop("_broken")
