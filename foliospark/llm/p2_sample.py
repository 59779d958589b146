"""Samples whose category shares follow given targets.

Categories are counted, integer quotas are allotted by largest remainder with floors and caps, the
records with the smallest random keys are drawn per category, and shortfalls are reported. Where
records have several categories, quotas are filled by a flow over the counts of category sets.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators.scale import running_totals, smallest_keys, unit_key
from foliospark.session import cut_lineage
from foliospark.sources.tables import table

#: Seed of the random keys.
SEED = 20260101


def category_key(c: Column) -> Column:
    """The form in which spellings of a category agree: lower case, ``&`` as "and", letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "&", " and ")), r"[^\p{L}\p{M}\p{N}]+", "")


def seed_categories(manifest: DataFrame) -> DataFrame:
    """(dimension, key, doc_id): every distinct category of every seed.

    Only rows of role ``seed`` count; a seed delivered twice counts once. Null or blank categories,
    null list entries and null ids give no row; an empty table gives none.
    """
    m = manifest.where((F.lower(F.trim("role")) == "seed") & F.col("doc_id").isNotNull())
    pairs = F.array(
        F.struct(F.lit("journal").alias("dimension"), F.array(F.col("journal")).alias("names")),
        F.struct(F.lit("pub_year").alias("dimension"), F.array(F.col("pub_year").cast("string")).alias("names")),
        F.struct(F.lit("subfields").alias("dimension"), F.col("subfields").alias("names")),
    )
    d = m.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.dimension", F.explode("p.names").alias("name"))
    return d.select("dimension", category_key(F.col("name")).alias("key"), "doc_id").where("key <> ''").distinct()


def availability(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """Every plan row with ``available`` (distinct seeds) and ``wanted`` (the larger of the minimum and the rounded share)."""
    keyed = plan.select("plan_id", "dimension", "category", "target_share", "min_rows", "sample_size").distinct().withColumn("_k", category_key(F.col("category")))
    # The plan is the small side: its size is given by its author, not by the corpus.
    n = seed_categories(manifest).groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("available"))
    joined = keyed.join(n, (keyed["dimension"] == n["dimension"]) & (keyed["_k"] == n["key"]), "left").drop(n["dimension"])
    share = F.round(F.round(F.col("target_share") * F.col("sample_size"), 6)).cast("long")
    return joined.select(
        "plan_id", "dimension", "category", "_k", "target_share", "min_rows", "sample_size",
        F.coalesce("available", F.lit(0)).cast("long").alias("available"),
        F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), F.coalesce(share, F.lit(0))).alias("wanted"),
    )


def quotas(counted: DataFrame) -> DataFrame:
    """Adds ``quota`` and ``unmet`` to plan rows that have ``target_share, min_rows, sample_size, available, wanted``.

    Largest remainder over the shares, then raised to the floor ``min(min_rows, available)`` and cut
    to ``available``. Where floors push the sum above the sample size, categories with the most rows
    above their floor give way first. Rows that caps take away go to the plan's other categories with
    a share, in proportion to what these have left, so the sample keeps its size as long as there are
    seeds. Ties fall to the smaller category name. ``unmet`` says that fewer seeds exist than wanted.
    """
    plan = Window.partitionBy("plan_id")
    d = counted.withColumn("_t", F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_size", F.lit(0)), 6))
    d = d.withColumn("_base", F.floor("_t")).withColumn("_frac", F.round(F.col("_t") - F.col("_base"), 6))
    d = d.withColumn("_size", F.round(F.sum("_t").over(plan)).cast("long"))
    d = d.withColumn("_units", F.col("_size") - F.sum("_base").over(plan))
    d = d.withColumn("_r", F.row_number().over(plan.orderBy(F.desc("_frac"), "category")))
    q = F.col("_base") + F.when((F.col("_r") <= F.col("_units")) & (F.col("_frac") > 0), 1).otherwise(0)
    floor = F.least(F.coalesce("min_rows", F.lit(0)).cast("long"), F.col("available"))
    d = d.withColumn("_floor", floor).withColumn("_q", F.least("available", F.greatest(q, F.col("_floor"))))
    d = d.withColumn("_slack", F.col("_q") - F.col("_floor"))
    d = d.withColumn("_over", F.greatest(F.lit(0), F.sum("_q").over(plan) - F.coalesce("sample_size", F.lit(0))))
    before = plan.orderBy(F.desc("_slack"), "category").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("_slack").over(before), F.lit(0)))
    give = F.greatest(F.lit(0), F.least("_slack", F.col("_over") - F.col("_before")))
    d = d.withColumn("_q", (F.col("_q") - give).cast("long"))
    # What caps left over, dealt systematically over the room of the others: shares of it end where the running sum of room does.
    d = d.withColumn("_room", F.when(F.col("_t") > 0, F.col("available") - F.col("_q")).otherwise(F.lit(0)))
    upto = plan.orderBy("category").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_upto": F.sum("_room").over(upto), "_rooms": F.sum("_room").over(plan), "_lack": F.greatest(F.lit(0), F.least(F.col("_size"), F.coalesce("sample_size", F.lit(0))) - F.sum("_q").over(plan))})
    part = lambda c: F.expr(f"({c}) * least(_lack, _rooms) div greatest(_rooms, 1)")
    d = d.withColumn("quota", (F.col("_q") + part("_upto") - part("_upto - _room")).cast("long"))
    own = ("_t", "_base", "_frac", "_size", "_units", "_r", "_floor", "_q", "_slack", "_over", "_before", "_room", "_upto", "_rooms", "_lack")
    return d.withColumn("unmet", F.col("available") < F.col("wanted")).drop(*own)


def shortfalls(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """(plan_id, category): plan categories for which fewer distinct seeds exist than wanted, as the quotas report them."""
    return quotas(availability(manifest, plan)).where("unmet").select("plan_id", "category")


def dealt(floors: list[int], wanted: list[int], shares: list[float], kinds: list[tuple[int, ...]], counts: list[int]) -> list[dict[int, int]]:
    """For every kind of records (the categories that they have, ``counts`` records each) how many go to which category.

    No record goes to two categories. Floors are filled first, then the wanted numbers, then what
    these couldn't take goes to categories with a share. A category that runs dry takes records that
    others have and can replace (augmenting paths), so as many floors, and then as many wanted rows,
    are filled as is possible at all, and nothing that was filled is lost again. Where a category has
    a choice it takes from its kinds in proportion to their records.
    """
    n = len(floors)
    left = list(counts)
    got: list[dict[int, int]] = [{} for _ in kinds]
    of: list[list[int]] = [[t for t, ks in enumerate(kinds) if c in ks] for c in range(n)]
    have = [0] * n

    def path(c: int) -> tuple[int, int, dict[int, tuple[int, int]]] | None:
        came: dict[int, tuple[int, int]] = {c: (-1, -1)}
        queue = [c]
        for v in queue:
            for t in of[v]:
                if left[t]:
                    return v, t, came
                for d, m in got[t].items():
                    if m and d not in came:
                        came[d] = (v, t)
                        queue.append(d)
        return None

    def fill(c: int, upto: int) -> None:
        free = sum(left[t] for t in of[c])
        need = min(upto - have[c], free)
        if need > 0:
            at = 0
            for t in of[c]:
                take = (at + left[t]) * need // free - at * need // free
                at += left[t]
                left[t] -= take
                got[t][c] = got[t].get(c, 0) + take
            have[c] += need
        while have[c] < upto and (p := path(c)):
            v, t, came = p
            size = min(upto - have[c], left[t])
            u = v
            while came[u][0] >= 0:
                size = min(size, got[came[u][1]][u])
                u = came[u][0]
            left[t] -= size
            while True:
                got[t][v] = got[t].get(v, 0) + size
                u, t = came[v]
                if u < 0:
                    break
                got[t][v] -= size
                v = u
            have[c] += size

    total = [sum(counts[t] for t in of[c]) for c in range(n)]
    for goal in (floors, wanted):
        for c in sorted(range(n), key=lambda c: (total[c] / max(goal[c], 1), c)):
            fill(c, goal[c])
    for c in sorted(range(n), key=lambda c: (-shares[c], c)):
        if shares[c] > 0 and (lack := sum(wanted) - sum(have)) > 0:
            fill(c, have[c] + lack)
    return got


_DEALT = "plan_id int, kind string, category string, upto long"


def _deal_plan(key, kinds: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    plan = plan.sort_values("category", kind="stable")
    names = plan["category"].tolist()
    number = {c: i for i, c in enumerate(names)}
    kinds = kinds.sort_values("kind")
    sets = [tuple(number[c] for c in json.loads(k)) for k in kinds["kind"]]
    floors = [min(f, q) for f, q in zip(plan["floor"].tolist(), plan["quota"].tolist())]
    got = dealt(floors, plan["quota"].tolist(), plan["target_share"].fillna(0.0).tolist(), sets, kinds["n"].tolist())
    rows = []
    for k, g in zip(kinds["kind"], got):
        upto = 0
        for c in sorted(g):
            if g[c]:
                upto += g[c]
                rows.append((key[0], k, names[c], upto))
    return pd.DataFrame(rows, columns=["plan_id", "kind", "category", "upto"]).astype({"plan_id": "int32", "upto": "int64"})


def draw(manifest: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(plan_id, category, doc_id): the drawn seeds of every plan; no seed is drawn twice in a plan.

    Quotas are allotted first. Seeds are then counted by the set of planned categories that they have;
    how many of each set go to which category is settled on these counts, plan by plan (their number
    depends on the plan's categories, not on the seeds), and each set gives its seeds with the
    smallest random keys. Null ids, repeated seeds and seeds without a planned category: see
    ``seed_categories``; an empty table or plan draws nothing.
    """
    counted = quotas(availability(manifest, plan)).select("plan_id", "dimension", "_k", "category", "quota", "target_share", F.least(F.coalesce("min_rows", F.lit(0)).cast("long"), F.col("available")).alias("floor"))
    cats = seed_categories(manifest).withColumnRenamed("dimension", "_d")
    pairs = cats.join(counted, (F.col("_d") == F.col("dimension")) & (F.col("key") == F.col("_k")))
    kind = F.to_json(F.sort_array(F.collect_set("category"))).alias("kind")
    seeds = cut_lineage(pairs.groupBy("plan_id", "doc_id").agg(kind))
    counts = seeds.groupBy("plan_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.toDF(*counted.columns)  # as columns of its own: the counts stem from it as well
    takes = cut_lineage(counts.groupBy("plan_id").cogroup(rows.groupBy("plan_id")).applyInPandas(_deal_plan, _DEALT))
    cuts = takes.groupBy("plan_id", "kind").agg(F.sort_array(F.collect_list(F.struct("upto", "category"))).alias("cuts"), F.max("upto").alias("_most"))
    rows = seeds.join(cuts, ["plan_id", "kind"]).withColumn("_u", unit_key(F.col("plan_id"), F.col("doc_id"), seed=seed))
    few = smallest_keys(rows, ["plan_id", "kind"], "_u", ["doc_id"], "_most")
    placed = running_totals(few, ["plan_id", "kind"], "_u", ["doc_id"], F.lit(1), "_at")
    return placed.select("plan_id", F.expr("filter(cuts, c -> c.upto > _at)[0].category").alias("category"), "doc_id")


def report(manifest: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(plan_id, category, available, wanted, quota, drawn, missing): what the sample holds of every category of a plan.

    ``missing`` is what the drawn rows lack of the wanted ones, be it that there are too few seeds, that
    floors of others took the room, or that its seeds were needed by other categories.
    """
    n = draw(manifest, plan, seed).groupBy(F.col("plan_id").alias("_p"), F.col("category").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    d = quotas(availability(manifest, plan)).join(n, (F.col("plan_id") == F.col("_p")) & (F.col("category") == F.col("_c")), "left").withColumn("drawn", F.coalesce("_n", F.lit(0)))
    return d.select("plan_id", "category", "available", "wanted", "quota", "drawn", F.greatest(F.lit(0), F.col("wanted") - F.col("drawn")).alias("missing"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortfalls(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "sample_plan"))


def p2_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = availability(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "sample_plan"))
    return quotas(counted).select("plan_id", "category", "available", "wanted", "quota")


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "sample_plan"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "sample_plan"))


_AVAILABLE = r"""
WITH cats AS (
  SELECT 'journal' AS dimension, journal AS name, doc_id FROM manifest WHERE role = 'seed'
  UNION ALL SELECT 'pub_year', CAST(pub_year AS VARCHAR), doc_id FROM manifest WHERE role = 'seed'
  UNION ALL SELECT 'subfields', unnest(subfields), doc_id FROM manifest WHERE role = 'seed'),
keyed AS (SELECT DISTINCT dimension, doc_id, regexp_replace(lower(replace(name, '&', ' and ')), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS k FROM cats WHERE name IS NOT NULL),
n AS (SELECT dimension, k, count(*) AS available FROM keyed WHERE k <> '' GROUP BY 1, 2),
counted AS (
  SELECT p.plan_id, p.category, p.target_share, p.min_rows, p.sample_size, coalesce(n.available, 0) AS available,
    greatest(p.min_rows, CAST(round(round(p.target_share * p.sample_size, 6)) AS BIGINT)) AS wanted
  FROM sample_plan p LEFT JOIN n ON n.dimension = p.dimension
    AND n.k = regexp_replace(lower(replace(p.category, '&', ' and ')), '[^\p{L}\p{M}\p{N}]+', '', 'g'))
"""

SQL = {
    "p2_found": _AVAILABLE + "SELECT plan_id, category FROM counted WHERE available < wanted",
    "p2_quotas": _AVAILABLE + """,
t AS (SELECT *, round(target_share * sample_size, 6) AS tt FROM counted),
b AS (SELECT *, floor(tt) AS base, round(tt - floor(tt), 6) AS frac FROM t),
u AS (SELECT *, CAST(round(sum(tt) OVER (PARTITION BY plan_id)) AS BIGINT) - sum(base) OVER (PARTITION BY plan_id) AS units,
        row_number() OVER (PARTITION BY plan_id ORDER BY frac DESC, category) AS r, least(min_rows, available) AS fl FROM b),
q AS (SELECT *, least(available, greatest(base + CASE WHEN r <= units AND frac > 0 THEN 1 ELSE 0 END, fl)) AS q0 FROM u),
s AS (SELECT *, q0 - fl AS slack, greatest(0, sum(q0) OVER (PARTITION BY plan_id) - sample_size) AS over_n FROM q),
g AS (SELECT *, coalesce(sum(slack) OVER (PARTITION BY plan_id ORDER BY slack DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM s),
h AS (SELECT *, CAST(q0 - greatest(0, least(slack, over_n - bef)) AS BIGINT) AS q1 FROM g),
k AS (SELECT *, CAST(CASE WHEN tt > 0 THEN available - q1 ELSE 0 END AS BIGINT) AS room FROM h),
l AS (SELECT *, CAST(sum(room) OVER (PARTITION BY plan_id ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto, CAST(sum(room) OVER (PARTITION BY plan_id) AS BIGINT) AS rooms,
  CAST(greatest(0, least(CAST(round(sum(tt) OVER (PARTITION BY plan_id)) AS BIGINT), sample_size) - sum(q1) OVER (PARTITION BY plan_id)) AS BIGINT) AS lack FROM k)
SELECT plan_id, category, CAST(available AS BIGINT) AS available, CAST(wanted AS BIGINT) AS wanted,
  CAST(q1 + upto * least(lack, rooms) // greatest(rooms, 1) - (upto - room) * least(lack, rooms) // greatest(rooms, 1) AS BIGINT) AS quota FROM l""",
}

QUERIES = {"p2_found": p2_found, "p2_quotas": p2_quotas, "p2_sample": p2_sample, "p2_report": p2_report}
