"""Page text to lines: line numbers, running headers, page numbers, and the start of the references.

Everything is keyed by document and page, so one exchange by document serves all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions import text as X
from foliospark.functions.python import nfkc

PAGE = ("doc_id", "page")


def split_pages(pages: DataFrame, normalise: bool = True) -> DataFrame:
    """(doc_id, page, line, raw, text) of pages (doc_id, page, text); lines count from 0.

    ``raw`` is the line as it came, ``text`` with broken glyphs repaired and NFKC applied. A null page
    failed and has no lines; an empty page has one empty line. Where normalising would change the
    number of lines, positions follow the raw text and extra lines are dropped.
    """
    fixed = X.repair_glyphs(F.col("text"))[0]
    d = pages.where("text IS NOT NULL").select(*PAGE, X.lines(F.col("text")).alias("raw"), X.lines(nfkc(fixed) if normalise else fixed).alias("fixed"))
    d = d.select(*PAGE, F.posexplode(F.arrays_zip("raw", "fixed")).alias("line", "z"))
    return d.where("z.raw IS NOT NULL").select(*PAGE, "line", "z.raw", F.coalesce("z.fixed", F.lit("")).alias("text"))


def failed_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, pages_total, pages_failed): the sorted numbers of the null pages of each document."""
    failed = F.sort_array(F.collect_list(F.when(F.col("text").isNull(), F.col("page"))))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages_total"), failed.alias("pages_failed"))


def _filled() -> Column:
    return X.strip(F.col("text")) != ""


def strip_line_numbers(lines: DataFrame) -> DataFrame:
    """Removes manuscript line numbers and adds ``numbered``, whether the page had them.

    A page has them if it has ten filled lines, seven in ten begin with a number, and eight in ten of
    these numbers are one more than the number before.
    """
    page = Window.partitionBy(*PAGE)
    number = F.when(_filled() & F.col("text").rlike(P.LINE_NUMBER), F.expr("try_cast(regexp_extract(text, _pattern, 1) AS INT)"))
    d = lines.withColumn("_pattern", F.lit(P.LINE_NUMBER)).withColumn("_n", number)
    before = F.last("_n", ignorenulls=True).over(page.orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_step", (F.col("_n") - before == 1).cast("int"))
    filled, numbers, steps = F.sum(_filled().cast("int")).over(page), F.count("_n").over(page), F.coalesce(F.sum("_step").over(page), F.lit(0))
    d = d.withColumn("numbered", (filled >= 10) & (numbers >= 0.7 * filled) & (steps >= 0.8 * (numbers - 1)))
    return d.withColumn("text", F.when(F.col("numbered"), F.regexp_replace("text", P.LINE_NUMBER, "")).otherwise(F.col("text"))).drop("_pattern", "_n", "_step")


def mark_edges(lines: DataFrame) -> DataFrame:
    """Adds ``edge``: whether a line is one of the first two or last two filled lines of its page."""
    page = Window.partitionBy(*PAGE)
    filled = _filled().cast("int")
    nth = F.sum(filled).over(page.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("edge", _filled() & ((nth <= 2) | (nth > F.sum(filled).over(page) - 2)))


def running_keys(lines: DataFrame) -> DataFrame:
    """(doc_id, key): edge lines, compared without digits and blanks, that stand on a third page and on half of all pages."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    keys = lines.where("edge").select(*PAGE, X.running_key(F.col("text")).alias("key")).where("key <> ''")
    n = keys.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n"))
    return n.join(pages, "doc_id").where("pages >= 3 AND n >= greatest(3, pages div 2)").select("doc_id", "key")


def page_offsets(lines: DataFrame) -> DataFrame:
    """(doc_id, shift): the printed page number less the page's place, where three edge lines agree; ties go to the first seen."""
    d = lines.where("edge").withColumn("_x", X.strip(F.col("text"))).where(F.col("_x").rlike(r"^\p{Nd}{1,4}$"))
    d = d.select("doc_id", (F.expr("try_cast(_x AS INT)") - F.col("page")).alias("shift"), F.struct("page", "line").alias("at"))
    n = d.groupBy("doc_id", "shift").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    best = n.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), F.col("at"), F.col("shift"), F.col("n").alias("count"))).alias("b"))
    return best.where("b.count >= 3").select("doc_id", "b.shift")


def drop_running(lines: DataFrame) -> DataFrame:
    """Lines without running headers, footers and page numbers."""
    d = lines.withColumn("key", F.when(F.col("edge"), X.running_key(F.col("text")))).join(running_keys(lines).withColumn("running", F.lit(True)), ["doc_id", "key"], "left").join(page_offsets(lines), "doc_id", "left")
    numbered = X.strip(F.col("text")) == (F.col("page") + F.col("shift")).cast("string")
    gone = F.col("edge") & (F.coalesce("running", F.lit(False)) | F.coalesce(numbered, F.lit(False)))
    return d.where(~gone).drop("key", "running", "shift")


def split_references(lines: DataFrame) -> DataFrame:
    """Adds ``part``: "body", "title" for the first heading of references in a document, "reference" behind it."""
    place = F.struct("page", "line")
    first = lines.where(F.col("text").rlike(P.REFERENCE_HEADING)).groupBy("doc_id").agg(F.min(place).alias("_first"))
    part = F.when(F.col("_first").isNull() | (place < F.col("_first")), "body").when(place == F.col("_first"), "title").otherwise("reference")
    return lines.join(first, "doc_id", "left").withColumn("part", part).drop("_first")


def line_issues(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, code, n) of what happened to the lines (marked ones) of ``pages``.

    glyphs_repaired (places), glyphs_broken (characters that stay unreadable), numbered_pages (that lost line
    numbers), running_lines (headers and footers by kind), page_numbers, references_not_found. Codes that
    don't apply have no row.
    """
    coded = lambda d, code, n: d.select("doc_id", F.lit(code).alias("code"), n.cast("long").alias("n"))
    repairs = pages.where("text IS NOT NULL").groupBy("doc_id").agg(F.sum(X.repair_glyphs(F.col("text"))[1]).alias("k")).where("k > 0")
    per_doc = lines.groupBy("doc_id").agg(
        F.sum(X.broken_glyphs(F.col("text"))).alias("broken"), F.count_distinct(F.when(F.col("numbered"), F.col("page"))).alias("numbered"),
    )
    found = drop_running(lines).groupBy("doc_id").agg(F.max(F.col("text").rlike(P.REFERENCE_HEADING)).alias("found"))
    every = lines.select("doc_id").distinct().join(found, "doc_id", "left").where("NOT coalesce(found, false)")
    out = [coded(repairs, "glyphs_repaired", F.col("k")), coded(per_doc.where("broken > 0"), "glyphs_broken", F.col("broken")), coded(per_doc.where("numbered > 0"), "numbered_pages", F.col("numbered"))]
    out += [coded(running_keys(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")), "running_lines", F.col("k")), coded(page_offsets(lines), "page_numbers", F.lit(1)), coded(every, "references_not_found", F.lit(1))]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]
