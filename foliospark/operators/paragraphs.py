"""Lines to typed, located segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions import text as X
from foliospark.operators import lines as lines_of
from foliospark.session import cut_lineage

BLOCK = ("doc_id", "page", "part")


def split_equations(lines: DataFrame) -> DataFrame:
    """Adds ``sub``: a line of an equation with text behind it becomes two rows."""
    x = X.strip(F.col("text"))
    both = F.array(F.regexp_extract(x, P.EQUATION_THEN_TEXT, 1), F.regexp_extract(x, P.EQUATION_THEN_TEXT, 2))
    parts = F.when(x.rlike(P.EQUATION_THEN_TEXT), both).otherwise(F.array(F.col("text")))
    return lines.select(*[c for c in lines.columns if c != "text"], F.posexplode(parts).alias("sub", "text"))


def fold_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, part, first, last, sub, text): lines (with part and sub) folded into paragraphs.

    A paragraph ends at an empty line, at a caption, and where a line ends a sentence and the next one
    begins like one; equations and headings stand alone. A hyphen before a small letter is closed up.
    Whether a heading counts depends on the line before, which may itself be a heading: that state is
    found by two running maxima instead of a loop.
    """
    w = Window.partitionBy(*BLOCK).orderBy("line", "sub")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    behind = w.rowsBetween(1, Window.unboundedFollowing)
    d = lines.withColumn("x", X.strip(F.col("text"))).withColumn("i", F.row_number().over(w))
    d = d.withColumns({"prev": F.lag("x").over(w), "next": F.first(F.when(F.col("x") != "", F.col("x")), ignorenulls=True).over(behind), "eq": X.is_equation_line(F.col("x")), "named": X.is_named_heading(F.col("x"))})
    d = d.withColumn("head", X.is_heading_line(F.col("x")) & ~F.coalesce(F.col("next"), F.lit("")).rlike(r"^\p{Ll}")).withColumn("prev_eq", F.coalesce(F.lag("eq").over(w), F.lit(False)))
    opens = F.col("prev").isNull() | (F.col("prev") == "") | F.col("prev_eq") | F.col("prev").rlike(r"[.:?!;]\z") | F.col("named")
    d = d.withColumn("sure", F.col("eq") | (F.col("head") & opens))
    d = d.withColumns({"last_sure": F.max(F.when(F.col("sure"), F.col("i"))).over(upto), "last_other": F.coalesce(F.max(F.when(~F.col("head"), F.col("i"))).over(upto), F.lit(-1))})
    d = d.withColumn("alone", F.coalesce(F.col("last_sure") >= F.col("last_other"), F.lit(False)))
    d = d.withColumn("prev_alone", F.coalesce(F.lag("alone").over(w), F.lit(False)))
    sentence = F.col("prev").rlike(r"[.:?!]\z") & F.col("x").rlike(r"^[A-Z0-9(\[]")
    begins = F.col("alone") | F.col("prev").isNull() | (F.col("prev") == "") | F.col("prev_alone") | F.col("x").rlike(P.CAPTION) | sentence
    d = d.withColumn("begins", (F.col("x") != "") & begins)
    d = d.withColumn("closed", ~F.col("begins") & F.col("prev").endswith("-") & F.col("x").rlike("^[a-z]"))
    d = d.withColumns({"pid": F.sum(F.col("begins").cast("int")).over(upto), "next_closed": F.coalesce(F.lead("closed").over(w), F.lit(False))})
    piece = F.concat(F.when(F.col("begins") | F.col("closed"), "").otherwise(" "), F.when(F.col("next_closed"), F.expr("left(x, length(x) - 1)")).otherwise(F.col("x")))
    rows = d.where("x <> ''").groupBy(*BLOCK, "pid").agg(F.sort_array(F.collect_list(F.struct("line", "sub", piece.alias("s")))).alias("p"))
    return rows.select(*BLOCK, F.element_at("p", 1)["line"].alias("first"), F.element_at("p", -1)["line"].alias("last"), F.element_at("p", 1)["sub"].alias("sub"), F.array_join(F.col("p.s"), "").alias("text"))


def paragraph_kind(text: Column, single: Column) -> Column:
    """The kind of a paragraph of the body; ``single`` says whether it is one line."""
    table = F.upper(F.regexp_extract(text, P.CAPTION, 1)) == "TABLE"
    return F.when(text.rlike(P.CAPTION), F.when(table, "table").otherwise("caption")).when(single & X.is_equation_line(text), "formula").when(single & X.is_heading_line(text), "heading").when(X.is_figure_text(text), "figure_text").otherwise("body")


def segments(lines: DataFrame) -> DataFrame:
    """(doc_id, seg_order, kind, text, page, first, last, loc) of lines with ``part``; order counts from 0."""
    paras = fold_paragraphs(split_equations(lines.where("part <> 'title'")))
    kind = F.when(F.col("part") == "reference", "reference").otherwise(paragraph_kind(F.col("text"), F.col("first") == F.col("last")))
    titles = lines.where("part = 'title'").select("doc_id", "page", "part", F.col("line").alias("first"), F.col("line").alias("last"), F.lit(0).alias("sub"), X.strip(F.col("text")).alias("text"), F.lit("heading").alias("kind"))
    every = paras.withColumn("kind", kind).unionByName(titles)
    # Pages are counted up first and rows ordered within a page, so a very long document is no hot task.
    sizes = every.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = every.join(sizes.select("doc_id", "page", before.alias("_before")), ["doc_id", "page"])
    order = (F.col("_before") + F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("first", "sub")) - 1).cast("int")
    loc = F.concat(F.lit("p"), "page", F.lit(":L"), "first", F.lit("-"), "last")
    return every.select("doc_id", order.alias("seg_order"), "kind", "text", "page", "first", "last", loc.alias("loc"), (F.col("part") == "title").alias("untraced"))


def with_traces(seg: DataFrame, raw: DataFrame) -> DataFrame:
    """Adds ``traces``, counted in the raw lines (doc_id, page, line, raw) of each segment; a line that two segments
    share counts for the first only, and the title of the references has none."""
    covered = seg.where("NOT untraced").select("doc_id", "seg_order", "page", F.explode(F.sequence("first", "last")).alias("line"))
    owner = covered.groupBy("doc_id", "page", "line").agg(F.min("seg_order").alias("seg_order"))
    counted = owner.join(raw, ["doc_id", "page", "line"]).select("doc_id", "seg_order", *[X.count(F.col("raw"), p).alias(k) for k, p in P.TRACES.items()])
    sums = counted.groupBy("doc_id", "seg_order").agg(*[F.sum(k).cast("int").alias(k) for k in P.TRACES])
    kinds = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, P.TRACES)), F.array(*P.TRACES)), lambda _, n: n > 0)
    joined = seg.join(sums, ["doc_id", "seg_order"], "left").withColumn("traces", F.coalesce(kinds, F.create_map().cast("map<string,int>")))
    return joined.drop(*P.TRACES, "untraced")


def source_text(seg: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc_id, seg_order, source): the raw lines of each segment's location, or null where it has none."""
    s = seg.select("doc_id", "seg_order", X.pdf_loc(F.col("loc")).alias("at"))
    lines = s.where("at IS NOT NULL").select("doc_id", "seg_order", F.col("at.page").alias("page"), F.explode(F.sequence("at.first", "at.last")).alias("line"))
    text = lines.join(raw, ["doc_id", "page", "line"]).groupBy("doc_id", "seg_order").agg(F.sort_array(F.collect_list(F.struct("line", "raw"))).alias("p"))
    return s.select("doc_id", "seg_order").join(text, ["doc_id", "seg_order"], "left").select("doc_id", "seg_order", F.array_join(F.col("p.raw"), "\n").alias("source"))


def mark_back_matter(seg: DataFrame) -> DataFrame:
    """Body behind a heading or label of back matter becomes ``back_matter``, up to the next other heading or the references."""
    text, kind = F.col("text"), F.col("kind")
    opens = ((kind == "heading") & X.is_back_heading(text)) | ((kind == "body") & text.rlike(P.BACK_LABEL))
    d = seg.withColumns({"_p": F.coalesce("page", F.lit(0)), "_switch": F.when(opens, True).when(kind == "heading", False)})
    # The state at the end of each page is carried over pages; only rows of one page are sorted together.
    pages = d.groupBy("doc_id", "_p").agg(F.max_by(F.col("_switch"), F.when(F.col("_switch").isNotNull(), F.col("seg_order"))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    pages = pages.select("doc_id", "_p", carried.alias("_carried"))
    ends = seg.where("kind = 'reference'").groupBy("doc_id").agg(F.min("seg_order").alias("_end"))
    within = F.last("_switch", ignorenulls=True).over(Window.partitionBy("doc_id", "_p").orderBy("seg_order").rowsBetween(Window.unboundedPreceding, 0))
    d = d.join(pages, ["doc_id", "_p"]).join(ends, "doc_id", "left").withColumn("_state", F.coalesce(within, F.col("_carried"), F.lit(False)))
    back = (kind == "body") & F.col("_state") & F.coalesce(F.col("seg_order") < F.col("_end"), F.lit(True))
    return d.withColumn("kind", F.when(back, "back_matter").otherwise(kind)).select(*seg.columns)


def mark_front_matter(seg: DataFrame) -> DataFrame:
    """Body before the first named heading or abstract within three pages becomes ``front_matter``, unless it reads like a
    sentence: twelve words, 15 % of them stopwords, and a finite verb."""
    text, kind = F.col("text"), F.col("kind")
    marker = (F.coalesce("page", F.lit(0)) <= 3) & (((kind == "heading") & X.is_named_heading(text)) | ((kind == "body") & text.rlike(P.ABSTRACT_LABEL)))
    first = seg.where(marker).groupBy("doc_id").agg(F.min("seg_order").alias("_first"))
    n = X.word_count(text)
    sentence = (n >= 12) & (X.count(text, P.STOP_TOKEN) >= 0.15 * n) & text.rlike(P.FINITE_VERB)
    front = (kind == "body") & F.coalesce(F.col("seg_order") < F.col("_first"), F.lit(False)) & ~sentence
    return seg.join(first, "doc_id", "left").withColumn("kind", F.when(front, "front_matter").otherwise(kind)).select(*seg.columns)


def read_pages(pages: DataFrame, normalise: bool = True) -> tuple[DataFrame, DataFrame]:
    """(segments, lines) of pages (doc_id, page, text) with front and back matter marked.

    Several steps look at all lines and at all segments, so each is written once to the shared
    checkpoint folder instead of being computed again for every look.
    """
    marked = cut_lineage(lines_of.mark_edges(lines_of.strip_line_numbers(lines_of.split_pages(pages, normalise))))
    seg = cut_lineage(segments(lines_of.split_references(cut_lineage(lines_of.drop_running(marked)))))
    return mark_front_matter(cut_lineage(mark_back_matter(seg))), marked
