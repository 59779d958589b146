"""Integrity of a catalogue of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import patterns as P


def manifest_errors(entries: DataFrame, files: DataFrame | None = None, order: str = "line_no") -> DataFrame:
    """(line_no, doc_id, rule_no, rule): broken rules of ``entries``, several per entry in rule order.

    Blank ids, repeated ids, unknown roles, variants whose bundle is no seed's, and, with ``files``
    (path, sha256), missing files and changed hashes. Joins are equi joins on ids and paths.
    """
    d = entries.withColumn("_twice", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) > 1)
    seeds = entries.where("role = 'seed' AND bundle_id IS NOT NULL").select("bundle_id").distinct().withColumn("_seed", F.lit(True))
    d = d.join(seeds, "bundle_id", "left")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    rules = [
        (1, "id_empty", empty("doc_id") | empty("bundle_id")),
        (2, "doc_id_repeated", F.col("_twice") & F.col("doc_id").isNotNull()),
        (3, "role_value", ~F.coalesce(F.col("role").isin(*P.ROLES), F.lit(False))),
        (4, "bundle_without_seed", (F.col("role") == "variant") & F.col("_seed").isNull()),
    ]
    if files is not None:
        f = files.select("path", F.col("sha256").alias("_hash")).dropDuplicates(["path"])
        d = d.join(f, "path", "left")
        rules += [(5, "file_missing", F.col("_hash").isNull()), (6, "hash_differs", F.col("_hash") != F.col("sha256"))]
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(n).alias("rule_no"), F.lit(name).alias("rule"))) for n, name, cond in rules]))
    return d.select(F.col(order).alias("line_no"), "doc_id", F.explode(hits).alias("e")).select("line_no", "doc_id", "e.*")


def manifest_counts(entries: DataFrame) -> DataFrame:
    """(dimension, value, n): entries by journal, year and subfield; a null value is the value null."""
    one = F.explode(F.array(F.struct(F.lit("journal").alias("dimension"), F.col("journal").alias("value")), F.struct(F.lit("pub_year").alias("dimension"), F.col("pub_year").cast("string").alias("value"))))
    plain = entries.select(one.alias("x")).select("x.*")
    fields = entries.select(F.lit("subfield").alias("dimension"), F.explode("subfields").alias("value"))
    return plain.unionByName(fields).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def candidates(entries: DataFrame, first_year: int, last_year: int, keywords: tuple[str, ...], licences: tuple[str, ...] = ("cc by",), journals: tuple[str, ...] = ()) -> DataFrame:
    """The entries that a search asks for: years, licences, journals (any if none is named), an archive number, and one of the
    keywords in the title. All of it but the keywords reaches the scan as pushed filters."""
    d = entries.where(F.col("pub_year").between(first_year, last_year) & F.col("license").isin(*licences) & F.col("pmcid").isNotNull() & (F.col("pmcid") != ""))
    d = d.where(F.col("journal").isin(*journals)) if journals else d
    title = F.lower("title")
    hit = F.lit(False)
    for w in keywords:
        hit = hit | F.contains(title, F.lit(w))
    return d.where(hit) if keywords else d
