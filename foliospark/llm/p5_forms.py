"""One consistent form for texts that look the same but differ in their characters.

Characters are folded (see ``textform``); then per token the dominant script is found and look-alike
letters are substituted in mixed-script tokens if the result is a word of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm import textform
from foliospark.session import cut_lineage
from foliospark.sources.tables import table


#: Parts into which the members of a spelling are spread.
SALTS = 16


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_FIRST = "id struct<doc_id:string,seg_order:int>, raw binary, form binary, folded string, words array<string>"


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, text in zip(b["id"], b["text"]):
            folded = textform.fold(text)
            if not folded:
                continue
            found = textform.candidates(folded)
            if found:
                rows.append((i, _digest(text), None, folded, list({f.lower() for _, forms in found for f in forms})))
            else:
                rows.append((i, _digest(text), _digest(folded), None, None))
        yield pd.DataFrame(rows, columns=["id", "raw", "form", "folded", "words"])


@F.pandas_udf(T.StringType())
def _repaired(folded: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([textform.repair(f, set(w) if w is not None else ()) for f, w in zip(folded, words)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _form(text: pd.Series) -> pd.Series:
    return pd.Series([_digest(t) for t in text], dtype=object)


def words_of(texts: DataFrame) -> DataFrame:
    """(word): the distinct lower-case words of all texts."""
    return texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("word")).where("word <> ''").distinct()


def _approved(suspects: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, ok): per text with mixed-script tokens, those repaired tokens that the corpus holds as words."""
    wanted = suspects.select("id", F.explode("words").alias("word"))
    known = wanted.select("word").distinct().join(words_of(texts), "word", "left_semi")
    return wanted.join(known, "word").groupBy("id").agg(F.collect_set("word").alias("ok"))


def _bodies(segments: DataFrame) -> DataFrame:
    keyed = segments.where("kind = 'body' AND text IS NOT NULL AND doc_id IS NOT NULL AND seg_order IS NOT NULL")
    return keyed.select(F.struct("doc_id", "seg_order").alias("id"), "text")


def forms(segments: DataFrame) -> DataFrame:
    """(id, raw, form): digests of the raw text and of its consistent form for every body segment with visible text.

    Of several deliveries of a segment the one with the smallest digest stands for all. Null, blank
    and invisible texts have no rows.
    """
    texts = _bodies(segments)
    first = cut_lineage(texts.mapInPandas(_first, _FIRST))
    suspects = first.where("folded IS NOT NULL")
    ok = _approved(suspects, texts)
    fixed = suspects.join(ok, "id", "left").select("id", "raw", _form(_repaired("folded", "ok")).alias("form"))
    every = first.where("folded IS NULL").select("id", "raw", "form").unionByName(fixed)
    return every.groupBy("id").agg(F.min(F.struct("raw", "form")).alias("m")).select("id", "m.raw", "m.form")


def look_alikes(segments: DataFrame) -> DataFrame:
    """Pairs of body segments whose texts look the same but aren't the same characters.

    Only digests are shuffled. Forms with a single spelling are dropped before members are paired, so
    copies that are equal character by character are never paired.
    """
    f = cut_lineage(forms(segments))
    several = f.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    # Spellings are paired before their members: equal texts, however many, never meet each other.
    spellings = f.join(several, "form").select("form", "raw").distinct()
    unlike = spellings.select("form", F.col("raw").alias("ra")).join(spellings.select("form", F.col("raw").alias("rb")), "form").where("ra < rb").drop("form")
    # A spelling may be that of a third of all segments: its members are spread over SALTS tasks, the few spellings go to each.
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    a = f.select(F.col("raw").alias("ra"), F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("sa"))
    b = f.select(F.col("raw").alias("rb"), F.col("id").alias("b"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("sb"))
    pairs = unlike.withColumn("sa", salt).join(a, ["ra", "sa"]).withColumn("sb", salt).join(b, ["rb", "sb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.select(F.col("a.doc_id").alias("doc_id_a"), F.col("a.seg_order").alias("seg_order_a"), F.col("b.doc_id").alias("doc_id_b"), F.col("b.seg_order").alias("seg_order_b"))


def classes(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_order, class_id, links): one row per body segment that looks like others of other characters, with how many
    those are; segments of a class look the same. Copies aren't expanded into pairs."""
    f = cut_lineage(forms(segments))
    spelled = f.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = spelled.groupBy("form").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("spellings")).where("spellings > 1")
    d = f.join(spelled, ["form", "raw"]).join(several, "form")
    return d.select("id.doc_id", "id.seg_order", F.lower(F.hex("form")).alias("class_id"), (F.col("members") - F.col("n")).alias("links"))


_EVERY = "id struct<doc_id:string,seg_order:int>, raw binary, folded string, words array<string>"


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, text in zip(b["id"], b["text"]):
            if text is None:
                rows.append((i, None, None, None))
                continue
            folded = textform.fold(text)
            found = textform.candidates(folded)
            rows.append((i, _digest(text), folded, list({f.lower() for _, forms in found for f in forms}) if found else None))
        yield pd.DataFrame(rows, columns=["id", "raw", "folded", "words"])


def consistent(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_order, text): every segment of any kind in the consistent form; null stays null, blank becomes empty.

    Of several deliveries of a segment the one with the smallest digest of its text counts, as in
    ``forms``; a null text counts only where no other was delivered.
    """
    texts = segments.select(F.struct("doc_id", "seg_order").alias("id"), "text")
    every = texts.mapInPandas(_folded, _EVERY)
    one = cut_lineage(every.groupBy("id").agg(F.min(F.struct(F.col("raw").isNull().alias("none"), "raw", "folded", "words")).alias("m")).select("id", "m.folded", "m.words"))
    ok = _approved(one.where("words IS NOT NULL"), texts.where("text IS NOT NULL"))
    fixed = one.where("words IS NOT NULL").join(ok, "id", "left").select("id", _repaired("folded", "ok").alias("text"))
    return one.where("words IS NULL").select("id", F.col("folded").alias("text")).unionByName(fixed).select("id.doc_id", "id.seg_order", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alikes(table(spark, sf_dir, "segments"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent(table(spark, sf_dir, "segments"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "segments"))


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_forms": p5_forms, "p5_classes": p5_classes}
