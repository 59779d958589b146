"""Train, validation and test splits that keep related records together.

Ties between records are contracted along smallest edges into a persisted spanning forest; its roots
are dealt to the splits systematically within bands of group size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators.components import components, spanning_forest
from foliospark.operators.scale import running_totals, unit_key
from foliospark.session import cut_lineage
from foliospark.sources.tables import table

#: Stand-ins that name no bundle, in lower case and without blanks and the prefix "b-". Fixed values.
STAND_INS = ("", "-", "--", "?", "??", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "unk", "und", "undefined", "missing", "tbd", "tba", "todo", "xxx", "x", "other", "not available", "unassigned")
#: A variant's id: the seed's id, the act and the model family. Where several acts stand in an id, the seed may end before any.
VARIANT_ID = r"^(.+{lazy})-(?:generation|rewriting|proofreading|translation|machine_translation|mixed|human_edited_ai|quoted_ai_output|search_ideation|unknown)-.+$"
#: Seed of the dealing order.
SEED = 20260102


def bundle_key(c: Column) -> Column:
    """``c`` in lower case without outer blanks; null where it names no bundle."""
    low = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    bare = F.regexp_replace(low, r"^b-\s*", "")
    return F.when(~bare.isin(*STAND_INS) & bare.rlike(r"[\p{L}\p{N}]"), low)


def records(*tables: DataFrame) -> DataFrame:
    """(doc_id, key): the distinct ids with their bundle keys; null ids are left out."""
    out = None
    for t in tables:
        x = t.where("doc_id IS NOT NULL").select("doc_id", bundle_key(F.col("bundle_id")).alias("key"))
        out = x if out is None else out.unionByName(x)
    return out.distinct()


def ties(rec: DataFrame) -> DataFrame:
    """Edges (a, b) between the records of a bundle, and between a variant and its seed where both are records."""
    named = rec.where("key IS NOT NULL")
    # A star around the smallest member; min and the join on the key are pre-aggregated or split by AQE.
    leader = named.groupBy("key").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    bundles = named.join(leader, "key").select(F.col("doc_id").alias("a"), "b")
    ids = rec.select("doc_id").distinct()
    before = [F.regexp_extract("doc_id", VARIANT_ID.replace("{lazy}", lazy), 1) for lazy in ("", "?")]
    variants = ids.select("doc_id", F.explode(F.array_distinct(F.array(*before))).alias("b")).where("b <> ''")
    seeds = variants.join(ids.select(F.col("doc_id").alias("b")), "b").select(F.col("doc_id").alias("a"), "b")
    return bundles.unionByName(seeds).where("a <> b")


def grouped(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, group_id) of all records; a record without ties is a group of its own."""
    rec = cut_lineage(records(manifest, labels))
    comp = components(ties(rec))
    ids = rec.select("doc_id").distinct()
    return ids.join(comp, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("group_id"))


def forest(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): the ties that hold the groups together, as few as possible, in the ids of the records; written to the shared folder."""
    _, edges = spanning_forest(ties(cut_lineage(records(manifest, labels))))
    return cut_lineage(edges)


def found(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, group_id) of all records whose group has two or more members.

    Null, blank and stand-in bundles tie nothing; repeated rows count once; empty tables give no rows.
    """
    comp = components(ties(cut_lineage(records(manifest, labels))))
    return comp.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def deal(groups: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, group_id, split): whole groups dealt to the splits of ``plan`` (split, share).

    Groups stand in bands of size (powers of two) and in a random order within a band; a group goes
    to the split in whose part of the band's records its middle record falls, so every band keeps the
    shares up to one group. Shares are scaled to one; null or negative shares count as none.
    """
    groups = groups.select("doc_id", "group_id")
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("band", F.floor(F.log2("n")).cast("int")).withColumn("u", unit_key(F.col("group_id"), seed=seed))
    placed = running_totals(sizes, ["band"], "u", ["group_id"], F.col("n"), "before", slices=1024)
    totals = sizes.groupBy(F.col("band").alias("_band")).agg(F.sum("n").alias("total"))
    placed = placed.join(totals, F.col("band") == F.col("_band")).withColumn("at", (F.col("before") + F.col("n") / 2) / F.col("total"))
    p = plan.select("split", "share").where("share > 0").withColumn("hi", F.sum("share").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("all", F.sum("share").over(Window.partitionBy()))
    cuts = p.select(F.struct((F.col("hi") / F.col("all")).alias("hi"), F.col("split")).alias("c")).agg(F.sort_array(F.collect_list("c")).alias("cuts"))
    hit = F.expr("coalesce(try_element_at(filter(cuts, c -> c.hi > at), 1).split, try_element_at(cuts, -1).split)")
    out = placed.join(F.broadcast(cuts)).select("group_id", hit.alias("split"))  # one row of as many cuts as the plan has splits
    return groups.join(out, "group_id").select("doc_id", "group_id", "split")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "label_records"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = cut_lineage(grouped(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "label_records")))
    return deal(groups, table(spark, sf_dir, "split_plan"))


def p3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "label_records"))


SQL = {
    "p3_found": r"""
WITH RECURSIVE r0 AS (
  SELECT doc_id, regexp_replace(lower(trim(bundle_id)), '^b-\s*', '') AS bare, lower(trim(bundle_id)) AS k
  FROM (SELECT doc_id, bundle_id FROM manifest UNION ALL SELECT doc_id, bundle_id FROM label_records) WHERE doc_id IS NOT NULL),
rec AS (SELECT DISTINCT doc_id, CASE WHEN bare NOT IN ('', '-', 'n/a', 'na', 'none', 'null', 'unknown', 'und', 'tbd') AND regexp_matches(bare, '[a-z0-9]') THEN k END AS k FROM r0),
ids AS (SELECT DISTINCT doc_id FROM rec),
v AS (SELECT doc_id, regexp_extract(doc_id, '^(.+)-(generation|rewriting|proofreading|translation|machine_translation|mixed)-[^-]+$', 1) AS seed FROM ids),
e0 AS (
  SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY k) AS b FROM rec WHERE k IS NOT NULL
  UNION SELECT v.doc_id, v.seed FROM v JOIN ids ON ids.doc_id = v.seed),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
walk AS (SELECT a AS s, a AS t FROM e UNION SELECT w.s, e.b FROM walk w JOIN e ON e.a = w.t)
SELECT s AS doc_id, min(t) AS group_id FROM walk GROUP BY s""",
}

QUERIES = {"p3_found": p3_found, "p3_splits": p3_splits, "p3_forest": p3_forest}
