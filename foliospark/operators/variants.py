"""Targets, tasks and results of paired text variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions import text as X
from foliospark.functions.python import word_similarity

#: Prompts by act; {title}, {abstract}, {text}, {k} are filled in, {PREVIOUS_OUTPUT} is left for the run.
PROMPTS = {
    "generation": ("The paper is called \"{title}\".\n\nAbstract:\n{abstract}\n\nDraft the opening {k} paragraphs of its introduction.",),
    "rewriting": ("Reword these {k} paragraphs; keep meaning and citations.\n\n{text}",),
    "proofreading": ("Correct language errors in these {k} paragraphs and change nothing else.\n\n{text}",),
    "translation": ("Translate these {k} paragraphs into Korean.\n\n{text}", "Translate these {k} paragraphs into English.\n\n{PREVIOUS_OUTPUT}"),
    "mixed": ("The paper is called \"{title}\". Continue each of these {k} unfinished paragraphs.\n\n{kept}",),
}


def find_targets(seg: DataFrame, paragraphs: int = P.TARGET_PARAGRAPHS, least: int = P.TARGET_WORDS) -> DataFrame:
    """(doc_id, locs, paragraphs): the first paragraphs of a document's introduction, where all are long enough and hold no formula.

    The introduction is the first section of the body with such a title; later ones aren't tried. Of XML
    only its own paragraphs count, not those of lists or nested sections. Other documents have no row.
    """
    xml = F.col("loc").rlike(r"^body\[1\]/")
    d = seg.where(F.col("section").rlike(P.INTRODUCTION) & F.col("kind").isin("body", "heading"))
    d = d.withColumn("_sec", F.when(xml, F.regexp_extract("loc", r"^(body\[1\]/sec\[\d+\])/(?:title|p)\[\d+\]$", 1)).otherwise(F.col("section"))).where("_sec <> ''")
    first = d.groupBy("doc_id").agg(F.min_by("_sec", "seg_order").alias("_first"))
    d = d.where("kind = 'body'").join(first, "doc_id").where("_sec = _first")
    good = (X.word_count(F.col("text")) >= least) & ~F.col("text").contains(P.PLACEHOLDER)
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_order"))).where(F.col("n") <= paragraphs)
    g = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.bool_and(good).alias("good"), F.sort_array(F.collect_list(F.struct("seg_order", "loc", "text"))).alias("p"))
    return g.where((F.col("k") == paragraphs) & F.col("good")).select("doc_id", F.col("p.loc").alias("locs"), F.col("p.text").alias("paragraphs"))


def kept_prefix(paragraph: Column) -> Column:
    """The first half of a paragraph's sentences, rounded up."""
    s = X.sentences(paragraph)
    return F.array_join(F.slice(s, 1, F.greatest(F.lit(1), F.floor((F.size(s) + 1) / 2).cast("int"))), " ")


def plan_tasks(targets: DataFrame, families: tuple[str, ...], seed: int, acts: tuple[str, ...] = P.PLANNED_ACTS) -> DataFrame:
    """One task per target (seed_id, title, abstract, locs, paragraphs) and act, with the model family alternating.

    The family is (place of the seed + place of the act + a hash of the seed) modulo their number. The
    place of the seed comes from a hash of its id as well, so no global order is needed.
    """
    act = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(a).alias("act")) for j, a in enumerate(acts)]))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("seed_id")), F.lit(len(families)))
    d = targets.withColumn("a", act).withColumn("act", F.col("a.act"))
    family = F.element_at(F.array(*map(F.lit, families)), (F.pmod(F.col("a.j") + offset, F.lit(len(families))) + 1).cast("int"))
    kept = F.transform(F.coalesce("paragraphs", F.array().cast("array<string>")), kept_prefix)
    k = F.size("paragraphs").cast("string")

    def fill(template: str) -> Column:
        c = F.lit(template)
        for name, value in {"title": F.col("title"), "abstract": F.col("abstract"), "text": F.array_join("paragraphs", "\n\n"), "kept": F.array_join(kept, "\n\n"), "k": k}.items():
            if "{" + name + "}" in template:
                c = F.replace(c, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
        return c

    steps = None
    for a in acts:
        s = F.array(*[fill(t) for t in PROMPTS[a]])
        steps = F.when(F.col("act") == a, s) if steps is None else steps.when(F.col("act") == a, s)
    d = d.withColumn("model_family", family)
    return d.select(F.concat_ws("-", "seed_id", "act", "model_family").alias("variant_id"), "seed_id", "act", "model_family", steps.alias("steps"), F.col("locs").alias("target_locs"), F.when(F.col("act") == "mixed", kept).otherwise(F.array().cast("array<string>")).alias("kept_prefix"))


def final_paragraphs(act: Column, kept: Column, output: Column, k: Column) -> Column:
    """The paragraphs of a variant from the last answer; for mixed acts behind the kept beginnings. Null where their number is wrong."""
    parts = X.split_output(output, k)
    joined = F.when(F.size(kept) == k, F.zip_with(kept, parts, lambda a, b: F.concat_ws(" ", a, b)))
    return F.when(act == "mixed", joined).otherwise(parts)


def latest(outputs: DataFrame) -> DataFrame:
    """The output of every variant with the latest ``created_at``."""
    at = F.try_to_timestamp(F.regexp_replace("created_at", "Z$", "+00:00"))
    cols = [c for c in outputs.columns if c != "variant_id"]
    return outputs.groupBy("variant_id").agg(F.max_by(F.struct(*cols), F.struct(at, F.col("created_at"), F.to_json("step_outputs"))).alias("o")).select("variant_id", "o.*")


def remaining(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tasks without an output."""
    return tasks.join(outputs.select("variant_id").distinct(), "variant_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def build(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """(variant_id, seed_id, act, status, paragraphs) of every task: no_output, paragraph_count or ok."""
    o = latest(outputs).select("variant_id", "step_outputs")
    d = tasks.join(o, "variant_id", "left").withColumn("_last", F.try_element_at("step_outputs", F.lit(-1)))
    d = d.withColumn("paragraphs", final_paragraphs(F.col("act"), F.col("kept_prefix"), F.col("_last"), F.size("target_locs")))
    status = F.when(F.col("_last").isNull(), "no_output").when(F.col("paragraphs").isNull(), "paragraph_count").otherwise("ok")
    return d.select("variant_id", "seed_id", "act", status.alias("status"), "paragraphs")


def relabel(pairs: DataFrame) -> DataFrame:
    """Adds ``label_act`` and ``changed`` to rows with ``act``, ``similarity`` and ``sentence_delta``.

    Proofreading that changed more than words or the number of sentences counts as rewriting, rewriting
    that changed next to nothing as proofreading; ``changed`` is false for proofreading without a change.
    """
    act, sim = F.col("act"), F.col("similarity")
    label = F.when((act == "proofreading") & ((sim < 0.9) | (F.col("sentence_delta") != 0)), "rewriting").when((act == "rewriting") & (sim >= 0.97), "proofreading").otherwise(act)
    return pairs.withColumns({"label_act": label, "changed": ~((act == "proofreading") & (sim >= 0.999))})


def check_changes(built: DataFrame, originals: DataFrame) -> DataFrame:
    """(variant_id, act, similarity, sentence_delta, label_act, changed) of built variants against the targets (seed_id, paragraphs)."""
    o = originals.select("seed_id", F.col("paragraphs").alias("before"))
    d = built.where("status = 'ok'").join(o, "seed_id").where(F.size("before") == F.size("paragraphs"))
    each = d.select("variant_id", "act", F.posexplode(F.arrays_zip("before", "paragraphs")).alias("i", "p"))
    each = each.select("variant_id", "act", word_similarity(F.col("p.before"), F.col("p.paragraphs")).alias("s"), (F.size(X.sentences(F.col("p.paragraphs"))) - F.size(X.sentences(F.col("p.before")))).alias("d"))
    g = each.groupBy("variant_id", "act").agg(F.avg("s").alias("similarity"), F.sum("d").alias("sentence_delta"))
    return relabel(g).withColumn("similarity", F.bround("similarity", 3))


def estimated_cost(usage: Column, input_price: float, output_price: float) -> Column:
    """Cost of an answer by its tokens (usage: input_tokens, output_tokens) at prices per million; null where usage is null."""
    return (usage["input_tokens"] * F.lit(input_price) + usage["output_tokens"] * F.lit(output_price)) / F.lit(1e6)
