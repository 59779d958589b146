"""Processing status and summaries without text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions import text as X


MEASURES = ("words", "tokens", "non_latin", "stop", "foreign")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts of a text's words and tokens from which the status follows; they add up over the texts of a document.

    The tokens are found once and kept in a column that all counts share.
    """
    d = df.withColumn("_tk", F.regexp_extract_all(F.lower(X.without_placeholder(F.coalesce(text, F.lit("")))), F.lit(f"([{P.LETTER}]+)"), 1))
    inside = lambda words: F.size(F.filter("_tk", lambda x: x.isin(words))).cast("long")
    other = F.size(F.filter("_tk", lambda x: F.octet_length(x) > F.length(x))).cast("long")
    return d.withColumns({"words": X.word_count(F.col(text)), "tokens": F.size("_tk").cast("long"), "non_latin": other, "stop": inside(P.STOPWORDS), "foreign": inside(P.FOREIGN_WORDS)}).drop("_tk")


def status(failed_pages: Column | None = None) -> Column:
    """The status of a document with columns ``words, tokens, non_latin, stop, foreign``; a given order of checks."""
    share = lambda c: F.col(c) / F.greatest("tokens", F.lit(1))
    other = (share("non_latin") > P.MAX_NON_LATIN) | (share("stop") < P.MIN_STOP) | (share("foreign") > P.MAX_FOREIGN)
    s = F.when(F.col("tokens") == 0, "extraction_failed").when(other, "out_of_scope").when(F.col("words") < P.MIN_WORDS, "too_short")
    return (s if failed_pages is None else s.when(failed_pages > 0, "partial")).otherwise("completed")


def assess(seg: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, words, tokens, non_latin, stop, foreign, status) of ``documents`` (doc_id, pages_failed) by their body segments."""
    names = list(MEASURES)
    body = measured(seg.where("kind = 'body'").select("doc_id", "text")).groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in names])
    d = documents.join(body, "doc_id", "left").na.fill(0, names)
    return d.select("doc_id", *names, status(F.size("pages_failed")).alias("status"))


def summarize(seg: DataFrame) -> DataFrame:
    """One row per document: counts by kind, body words, placeholders and trace sums; never any text."""
    body = F.col("kind") == "body"
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in P.KINDS]
    traces = [F.sum(F.coalesce(F.try_element_at("traces", F.lit(k)), F.lit(0))).cast("long").alias(f"trace_{k}") for k in P.TRACES]
    in_body = [F.sum(F.when(body, F.coalesce(F.try_element_at("traces", F.lit(k)), F.lit(0))).otherwise(0)).cast("long").alias(f"body_trace_{k}") for k in P.TRACES]
    n = F.coalesce(F.sum(F.when(body, X.word_count(F.col("text")))), F.lit(0)).alias("body_words")
    marks = F.coalesce(F.sum(F.when(body, X.count(F.col("text"), r"\[FORMULA\]"))), F.lit(0)).alias("placeholders")
    return seg.groupBy("doc_id").agg(*kinds, n, marks, *traces, *in_body)


def inspect(seg: DataFrame) -> DataFrame:
    """One row per document with body segments: the shape of its paragraphs in numbers."""
    t = F.col("text")
    chunks = F.greatest(X.chunk_count(t), F.lit(1))
    like = t.rlike(P.EQUATION_LIKE)
    d = seg.where("kind = 'body' AND text IS NOT NULL").select(
        "doc_id", X.word_count(t).alias("n"), (~t.rlike(r"[.?!:;)\]\"']\z")).alias("open_end"), t.rlike(r"^\p{Ll}").alias("small"), t.rlike(r"^\p{Nd}").alias("digit"), (X.count(t, P.NUMERIC_TOKEN) >= 0.2 * chunks).alias("numbers"),
        X.broken_glyphs(t).alias("broken"), like.alias("equation"), (like & ~X.is_equation_line(t)).alias("equation_words"), (F.size(F.coalesce("traces", F.create_map().cast("map<string,int>"))) > 0).alias("traced"),
    )
    bins = {"under_10": "n < 10", "from_10": "n BETWEEN 10 AND 29", "from_30": "n BETWEEN 30 AND 79", "from_80": "n BETWEEN 80 AND 199", "from_200": "n >= 200"}
    # The upper median: with an even number of paragraphs the greater of the two in the middle. It is read off the counts
    # of equal lengths, so the paragraphs of a long document are never gathered.
    lengths = d.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("doc_id")
    lengths = lengths.withColumns({"upto": F.sum("c").over(w.orderBy("n")), "every": F.sum("c").over(w)})
    median = lengths.where("upto > every div 2").groupBy("doc_id").agg(F.min("n").alias("median_words"))
    flags = {"open_end": "open_end", "starting_small": "small", "starting_digit": "digit", "mostly_numbers": "numbers", "equation_like": "equation", "equation_with_words": "equation_words", "with_traces": "traced", "equation_broken": "equation AND broken > 0"}
    shape = d.groupBy("doc_id").agg(*[F.count_if(F.expr(e)).alias(k) for k, e in bins.items()], F.sum("broken").alias("broken_glyphs"), *[F.count_if(F.expr(e)).alias(k) for k, e in flags.items()])
    return shape.join(median, "doc_id")


def pages_without_body(seg: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, pages): the numbers of the pages of ``documents`` (doc_id, pages_total) on which no body segment begins."""
    have = seg.where("kind = 'body'").groupBy("doc_id").agg(F.collect_set("page").alias("have"))
    none = F.array().cast("array<int>")
    every = F.when(F.col("pages_total") > 0, F.sequence(F.lit(1), F.col("pages_total").cast("int"))).otherwise(none)
    return documents.join(have, "doc_id", "left").select("doc_id", F.array_except(every, F.coalesce("have", none)).alias("pages"))


def segment_issues(seg: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, code, n) of what the segments of ``documents`` (doc_id, pages_failed) show: front_not_found, no_body, out_of_scope
    and failed_pages (their number)."""
    text = F.col("text")
    marker = (F.coalesce("page", F.lit(0)) <= 3) & (((F.col("kind") == "heading") & X.is_named_heading(text)) | (F.col("kind").isin("body", "front_matter") & text.rlike(P.ABSTRACT_LABEL)))
    front = seg.groupBy("doc_id").agg(F.max(marker).alias("_front"))
    d = assess(seg, documents).join(front, "doc_id", "left").join(documents.select("doc_id", F.size("pages_failed").alias("_failed")), "doc_id")
    code = lambda flag, name, n=1: F.when(flag, F.struct(F.lit(name).alias("code"), F.lit(n).cast("long").alias("n")))
    failed = F.when(F.col("_failed") > 0, F.struct(F.lit("failed_pages").alias("code"), F.col("_failed").cast("long").alias("n")))
    found = F.array_compact(F.array(code(~F.coalesce("_front", F.lit(False)), "front_not_found"), code(F.col("status") == "extraction_failed", "no_body"), code(F.col("status") == "out_of_scope", "out_of_scope"), failed))
    return d.select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.*")
