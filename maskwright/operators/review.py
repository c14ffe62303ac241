"""Human review sets and their progress; disagreement examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import labels as L
from maskwright.functions.arrays import total
from maskwright.functions.text import selected_words
from maskwright.session import with_once
from maskwright.operators.sampling import light_heavy_sample, per_outcome_sample

ZERO_TYPES = lambda column: F.transform(column, lambda _: F.lit("O"))


def editable_copy(rows: DataFrame) -> DataFrame:
    """Teacher-labelled rows as a review table: teacher labels kept, an editable copy, status pending."""
    have = set(rows.columns)
    pick = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    return rows.select(
        "id", "text", "words", "task_label", F.col("labels").alias("teacher_labels"),
        pick("selected_words", selected_words(F.col("words"), F.col("labels"))).alias("teacher_selected_words"),
        pick("needs_review", F.lit(False)).alias("teacher_needs_review"),
        pick("review_reason", F.lit("")).alias("teacher_review_reason"),
        F.col("labels").alias("human_labels"), pick("needs_review", F.lit(False)).alias("human_needs_review"),
        pick("review_reason", F.lit("")).alias("human_review_reason"), F.lit("pending").alias("review_status"))


def rule_review(rows: DataFrame, count: int, seed: int, dataset: str = "dataset") -> DataFrame:
    """A light/heavy sample per dataset as review rows."""
    masked = with_once(rows, _k=F.expr(total("labels")))
    chosen = light_heavy_sample(masked, "_k", count, seed, [dataset]).drop("_k")
    return chosen.select(
        "id", dataset, "text", "words", F.col("labels").alias("rule_labels"),
        (F.coalesce("types", ZERO_TYPES("labels")) if "types" in rows.columns else ZERO_TYPES("labels")).alias("rule_types"),
        selected_words(F.col("words"), F.col("labels")).alias("rule_selected_words"),
        F.col("labels").alias("human_labels"), F.lit(False).alias("human_reviewed"), F.lit("").alias("human_review_reason"))


def review_table(inputs: DataFrame, candidates: DataFrame, methods: Sequence[str], shared_only: bool = False,
                 initialize_from: str | None = None) -> DataFrame:
    """Inputs with a map of candidate labels per method, and whether the candidates disagree.

    ``candidates``: id, method, labels and optionally types. A group is the candidate
    methods of one document.
    """
    types = F.col("types") if "types" in candidates.columns else F.lit(None).cast("array<string>")
    grouped = candidates.filter(F.col("method").isin(*methods)).select(
        "id", "method", "labels", F.coalesce(types, ZERO_TYPES("labels")).alias("types")).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("method", "labels", "types"))).alias("_c"),
        F.count_distinct("labels").alias("_distinct"))
    # as many rows as documents, with their labels: never through the driver, whatever the size estimate
    joined = inputs.join(grouped.hint("merge"), "id", "left")
    entries = F.transform("_c", lambda c: F.struct(c["method"], F.struct(
        c["labels"].alias("labels"), c["types"].alias("types"),
        selected_words(F.col("words"), c["labels"]).alias("selected_words"))))
    none = F.create_map().cast("map<string,struct<labels:array<int>,types:array<string>,selected_words:array<string>>>")
    out = joined.withColumn("candidates", F.coalesce(F.map_from_entries(entries), none))
    if shared_only:
        out = out.filter(F.size("candidates") == len(methods))
    blank = F.transform("words", lambda _: F.lit(0))
    initial = F.coalesce(F.try_element_at("candidates", F.lit(initialize_from))["labels"], blank) if initialize_from else blank
    return out.select(
        "id", "text", "words", "task_label", "candidates",
        (F.coalesce("_distinct", F.lit(0)) > 1).alias("candidate_disagreement"), initial.alias("human_labels"),
        ZERO_TYPES("words").alias("human_types"), F.lit(False).alias("human_reviewed"), F.lit("").alias("human_review_reason"))


def review_progress(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Valid, total, reviewed and changed rows per dataset."""
    fine = L.label_error("words", "human_labels").isNull() & L.label_error("words", "rule_labels").isNull()
    return rows.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(fine).alias("valid"), F.count_if("human_reviewed").alias("reviewed"),
        F.count_if(F.col("human_labels") != F.col("rule_labels")).alias("changed_from_rule"))


def disagreement_examples(rows: DataFrame, per_outcome: int, seed: int, by: Sequence[str] = (), longest: int | None = None) -> DataFrame:
    """Examples with a sensitive word, of ``longest`` words at most if given, sampled per outcome (gold: labels, pred)."""
    eligible = rows.filter(F.array_max("labels") == 1)
    if longest is not None:
        eligible = eligible.filter(F.size("words") <= longest)
    typed = with_once(eligible, outcome=L.outcome("labels", "pred"))
    return per_outcome_sample(typed, by, per_outcome, seed).select(
        "*", selected_words(F.col("words"), F.col("labels")).alias("rule_selected_words"),
        selected_words(F.col("words"), F.transform("pred", lambda p: F.coalesce(p, F.lit(0)))).alias("student_selected_words"))
