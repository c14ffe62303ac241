"""Scoring of label systems on clean/noisy pairs, and the acceptance gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import labels as L
from maskwright.operators.metrics import ratio, with_scores

COUNTS = ("tp", "fp", "fn", "tn")


def attach_predictions(pairs: DataFrame, predictions: DataFrame, column: str, key: str = "pair_id") -> DataFrame:
    """Add predicted labels (key, labels) of one system; a missing prediction stays null."""
    return pairs.join(predictions.select(key, F.col("labels").alias(column)).hint("merge"), key, "left")


def reuse_source_predictions(pairs: DataFrame, predictions: DataFrame, column: str) -> DataFrame:
    """Attach one clean prediction per source to all of its pairs.

    ``predictions`` has one row per source_id, so the join cannot multiply pairs.
    """
    return pairs.join(predictions.select("source_id", F.col("labels").alias(column)).hint("merge"), "source_id", "left")


def sources_to_predict(pairs: DataFrame) -> DataFrame:
    """The clean text of each source once.

    All pairs of a source carry the same clean text. A source's pairs are reduced to one
    where they are made, so that texts move once a source and not once a pair.
    """
    return pairs.select("source_id", "clean_text", "clean_words").dropDuplicates(["source_id"])


def score_pairs(pairs: DataFrame, systems: dict[str, tuple[str, str]], carry: Sequence[str] = ()) -> DataFrame:
    """Reduce pairs to flat flags and counts, inside each row.

    ``systems`` maps a name to its (clean, noisy) label columns. Yields per system
    ``<name>_clean`` / ``<name>_noisy`` (target detected, 0/1) and
    ``<name>_c`` / ``<name>_n`` (struct of token counts).
    """
    columns: list[Column] = []
    for name, (clean, noisy) in systems.items():
        columns += [
            L.detected("clean_target_words", clean).cast("int").alias(f"{name}_clean"),
            L.detected("target_words", noisy).cast("int").alias(f"{name}_noisy"),
            L.confusion("clean_labels", clean).alias(f"{name}_c"),
            L.confusion("labels", noisy).alias(f"{name}_n"),
        ]
    return pairs.select("pair_id", "source_id", "noise_type", *carry, *columns)


def with_combinations(pairs: DataFrame, rule: tuple[str, str], student: tuple[str, str]) -> DataFrame:
    """Add or_clean, or_noisy, and_clean, and_noisy label columns."""
    return pairs.select("*", *[
        L.combine(rule[i], student[i], mode).alias(f"{mode}_{side}_labels")
        for mode in ("or", "and") for i, side in enumerate(("clean", "noisy"))])


def system_long(scored: DataFrame, names: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per pair and system: system, clean_hit, noisy_hit, c (clean counts), n (noisy counts)."""
    return scored.select("pair_id", "source_id", "noise_type", *carry, F.inline(F.array(*[F.struct(
        F.lit(name).alias("system"), F.col(f"{name}_clean").alias("clean_hit"), F.col(f"{name}_noisy").alias("noisy_hit"),
        F.col(f"{name}_c").alias("c"), F.col(f"{name}_n").alias("n")) for name in names])))


def token_scores(long: DataFrame, side: str, by: Sequence[str] = ("system",)) -> DataFrame:
    """Token metrics on the clean (``c``) or noisy (``n``) side."""
    return with_scores(long.groupBy(*by).agg(*[F.sum(f"{side}.{k}").alias(k) for k in COUNTS]))


def noisy_scores_by_noise(long: DataFrame) -> DataFrame:
    """Noisy token metrics per system and noise type, and per system over all (noise_type null)."""
    sums = long.groupBy("system", "noise_type").agg(*[F.sum(f"n.{k}").alias(k) for k in COUNTS])
    return with_scores(sums.rollup("system", "noise_type").agg(*[F.sum(k).alias(k) for k in COUNTS]).filter(
        F.col("system").isNotNull()))


def survival(long: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Target detection, eligible clean targets, span survival and newly leaked rate."""
    sums = long.groupBy(*by).agg(
        F.avg("clean_hit").alias("clean_target_detection"), F.avg("noisy_hit").alias("noisy_target_detection"),
        F.sum("clean_hit").alias("eligible_clean_targets"),
        F.sum(F.col("clean_hit") * F.col("noisy_hit")).alias("_kept"))
    kept = ratio(F.col("_kept"), F.col("eligible_clean_targets"))
    return sums.select(
        "*", kept.alias("span_survival_rate"), (1 - kept).alias("newly_leaked_span_rate")).drop("_kept")


def acceptance(metrics: DataFrame) -> DataFrame:
    """The six gates as rows (gate, pass, value, criteria) for each metric row.

    Needs clean_f1, clean_f2, clean_recall, noisy_f2, noisy_mask_rate, newly_leaked (student),
    rule_noisy_f2, rule_noisy_mask_rate, rule_newly_leaked, delta_f2_low, shared_delta,
    shared_low, absolute_low, drop_advantage_low.
    """
    c = F.col
    gap = F.abs(c("noisy_mask_rate") - c("rule_noisy_mask_rate"))
    # The thresholds of the gates.
    gates = (
        ("final_student_quality", (c("clean_f1") >= 0.85) & (c("clean_f2") >= 0.90) & (c("clean_recall") >= 0.90),
         c("clean_f2"), "clean F1>=0.85, F2>=0.90, Recall>=0.90"),
        ("matched_budget", gap <= 0.01, gap, "absolute noisy mask-rate gap <= 0.01"),
        ("robustness_superiority", (c("noisy_f2") > c("rule_noisy_f2")) & (c("newly_leaked") < c("rule_newly_leaked"))
         & (c("delta_f2_low") > 0), c("delta_f2_low"), "higher noisy F2, fewer newly leaked spans, delta F2 interval above zero"),
        ("absolute_target_robustness", (c("absolute_low") > 0) & (c("drop_advantage_low") > 0), c("absolute_low"),
         "detection and drop advantage intervals above zero on all targets"),
        ("conditional_surface_robustness", (c("shared_low") > 0) & (c("shared_delta") >= 0.05), c("shared_delta"),
         "survival >= rule + 5 points on shared targets, interval above zero"),
        ("pilot_quality", (c("clean_f2") >= 0.80) & (c("clean_recall") >= 0.85), c("clean_f2"),
         "exploratory: clean F2>=0.80 and Recall>=0.85"),
    )
    keys = [k for k in ("dataset", "model", "seed") if k in metrics.columns]
    return metrics.select(*keys, F.inline(F.array(*[F.struct(
        F.lit(name).alias("gate"), ok.alias("pass"), value.cast("double").alias("value"), F.lit(text).alias("criteria"))
        for name, ok, value, text in gates])))
