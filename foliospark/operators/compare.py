"""How well one extraction of a document agrees with another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions import text as X
from foliospark.functions.python import alignment

#: Tokens of a block that shows the reading order, and of one that shows leaked references.
ORDER_BLOCK, LEAK_BLOCK = 20, 8


def document_text(seg: DataFrame, kind: str = "body") -> DataFrame:
    """(doc_id, text): the segments of a kind in order, with empty lines between."""
    p = F.sort_array(F.collect_list(F.struct("seg_order", "text")))
    return seg.where((F.col("kind") == kind) & F.col("text").isNotNull()).groupBy("doc_id").agg(F.array_join(p["text"], "\n\n").alias("text"))


def compare(truth: DataFrame, other: DataFrame) -> DataFrame:
    """One row per document of ``truth`` (doc_id, body, reference) with ``other`` (the same): recall, precision, order,
    chemical formulas found, leaked references, ligatures. Null texts count as empty."""
    t = truth.select("doc_id", F.coalesce("body", F.lit("")).alias("tb"), F.coalesce("reference", F.lit("")).alias("tr"))
    o = other.select("doc_id", F.coalesce("body", F.lit("")).alias("ob"), F.coalesce("reference", F.lit("")).alias("orf"))
    d = t.join(o, "doc_id", "left").na.fill("", ["ob", "orf"])
    d = d.withColumns({"m": alignment("tb", "ob", F.lit(ORDER_BLOCK)), "leak": alignment("tr", "ob", F.lit(LEAK_BLOCK))})
    chem, seen = X.chemical_tokens(F.col("tb")), F.regexp_extract_all(F.concat("ob", F.lit(" "), "orf"), F.lit(f"({P.TOKEN})"), 1)
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    return d.select(
        "doc_id", (F.col("m.matched") / at_least_one(F.col("m.a_tokens"))).alias("recall"), (F.col("m.matched") / at_least_one(F.col("m.b_tokens"))).alias("precision"), (F.col("m.in_long_blocks") / at_least_one(F.col("m.a_tokens"))).alias("order"),
        (F.size(F.array_intersect(chem, seen)) / at_least_one(F.size(chem))).alias("chem"), (F.col("leak.in_long_blocks") / at_least_one(F.col("leak.a_tokens"))).alias("ref_leak"), X.count(F.col("ob"), P.LIGATURE).alias("ligatures"),
    )
