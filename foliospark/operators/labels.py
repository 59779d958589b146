"""Verdicts per stage from labelled acts, and checks of label records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions import text as X
from foliospark.sources.files import write_json_lines


def stage_verdict(stage: str) -> Column:
    """yes, no or unknown (never null) for a record with ``acts, truth_basis, rest_basis``.

    yes: one of the stage's acts is there. no: no act is unknown and every basis rules the stage out
    (A always, D all but machine translation). Null acts count as none, a null basis rules out nothing.
    """
    acts = F.coalesce("acts", F.array().cast("array<string>"))
    ruling = ["A", "D"] if stage != "machine_translation" else ["A"]
    out = lambda c: F.coalesce(F.col(c).isin(*ruling), F.lit(False))
    rest = F.col("rest_basis").isNull() | (F.col("rest_basis") == "") | out("rest_basis")
    hit = F.arrays_overlap(F.array_compact(acts), F.array(*map(F.lit, P.STAGES[stage])))
    return F.when(hit, "yes").when(F.coalesce(F.array_contains(F.array_compact(acts), "unknown"), F.lit(False)), "unknown").when(out("truth_basis") & rest, "no").otherwise("unknown")


def with_stages(records: DataFrame) -> DataFrame:
    """Adds ``derived``, the MAP of the stages to their verdicts."""
    return records.withColumn("derived", F.map_from_arrays(F.array(*map(F.lit, P.STAGES)), F.array(*[stage_verdict(s) for s in P.STAGES])))


def tally(records: DataFrame) -> DataFrame:
    """(stage, verdict, n) over all records."""
    return with_stages(records).select(F.explode("derived").alias("stage", "verdict")).groupBy("stage", "verdict").agg(F.count(F.lit(1)).alias("n"))


def _blank(c: str) -> Column:
    return F.coalesce(X.strip(F.col(c)) == "", F.lit(True))


def label_errors(records: DataFrame, order: str = "line_no") -> DataFrame:
    """(line_no, doc_id, rule_no, rule, item): every broken rule of every record, in rule order.

    A record may break several rules, and one rule several times (``item`` tells them apart). Errors
    don't remove records.
    """
    acts = F.coalesce("acts", F.array().cast("array<string>"))
    each = lambda flag, rule, no: F.when(flag, F.array(F.struct(F.lit(no).alias("rule_no"), F.lit(rule).alias("rule"), F.lit("").alias("item"))))
    spans = F.coalesce("spans", F.array().cast("array<struct<act:string,loc:string,lang:string>>"))

    def per_span(bad, rule: str, no: int) -> Column:
        return F.transform(F.filter(spans, bad), lambda s: F.struct(F.lit(no).alias("rule_no"), F.lit(rule).alias("rule"), F.coalesce(s["loc"], F.lit("")).alias("item")))

    d = with_stages(records).withColumn("_twice", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) > 1)
    declared = F.col("target_present")
    stored = F.filter(F.map_entries(F.coalesce("stages", F.create_map().cast("map<string,string>"))), lambda e: ~F.try_element_at(F.col("derived"), e["key"]).eqNullSafe(e["value"]))
    lists = [
        each(_blank("doc_id"), "doc_id_blank", 1),
        each(_blank("bundle_id"), "bundle_id_blank", 2),
        each(F.size(F.array_distinct(acts)) != F.size(acts), "acts_repeated", 3),
        each((F.col("truth_basis") == "D") & (F.size(F.array_except(acts, F.array(F.lit("machine_translation")))) > 0), "basis_d_with_act", 4),
        per_span(lambda s: ~F.coalesce(F.array_contains(acts, s["act"]), F.lit(False)), "span_act_not_in_acts", 5),
        per_span(lambda s: F.coalesce(X.strip(s["loc"]) == "", F.lit(True)), "span_loc_blank", 6),
        per_span(lambda s: ~F.coalesce(s["lang"].isin("en", "ko"), F.lit(False)), "span_lang", 7),
        each(declared.isNotNull() & (declared != "") & (declared != F.col("derived")["body"]), "target_present_differs", 8),
        F.transform(stored, lambda e: F.struct(F.lit(9).alias("rule_no"), F.lit("stage_differs").alias("rule"), e["key"].alias("item"))),
        each(F.col("doc_id").isNotNull() & F.col("_twice"), "doc_id_repeated", 10),
        each(~F.coalesce(F.col("truth_basis").isin(*P.BASES), F.lit(False)), "truth_basis_value", 11),
        each(F.size(F.array_except(acts, F.array(*map(F.lit, P.ACTS)))) > 0, "act_value", 12),
    ]
    none = F.array().cast("array<struct<rule_no:int,rule:string,item:string>>")
    return d.select(F.col(order).alias("line_no"), "doc_id", F.explode(F.flatten(F.array(*[F.coalesce(x, none) for x in lists]))).alias("e")).select("line_no", "doc_id", "e.*")


def save_labels(records: DataFrame, path: str, order: str = "doc_id") -> None:
    """Writes label records as JSON lines with their derived stages and presence; writes nothing and raises ``ValueError``
    with the first five errors if any record breaks a rule."""
    numbered = records.withColumn("line_no", F.col(order))
    bad = label_errors(numbered).orderBy("line_no", "rule_no", "item").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['doc_id']}: {r['rule']}" for r in bad))
    columns = [c for c in records.columns if c not in ("stages", "target_present")]
    out = with_stages(records).select(*columns, F.col("derived")["body"].alias("target_present"), F.col("derived").alias("stages"))
    write_json_lines(out, path, out.columns)
