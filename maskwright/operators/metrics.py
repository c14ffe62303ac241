"""Token, span and threshold metrics.

Word labels are compared inside the row, so only a few counts per row take part in an
aggregate and those are combined before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import labels as L

# The ninety-one candidate thresholds; taken from numpy once so that every engine
# compares against exactly the same doubles.
THRESHOLDS = tuple(float(t) for t in np.linspace(0.05, 0.95, 91))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion_sums(rows: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Summed tp, fp, fn, tn of label arrays, optionally per group."""
    counted = rows.select(*by, L.confusion(gold, pred).alias("c"))
    return counted.groupBy(*by).agg(*[F.coalesce(F.sum(f"c.{n}"), F.lit(0)).alias(n) for n in ("tp", "fp", "fn", "tn")])


def with_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, F2, mask rates, residual and overmask rate from tp/fp/fn/tn."""
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    recall = ratio(tp, tp + fn)
    return counts.select(
        "*", n.alias("tokens"), ratio(tp, tp + fp).alias("precision"), recall.alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(5 * tp, 5 * tp + 4 * fn + fp).alias("f2"),
        ratio(tp + fn, n).alias("gold_mask_rate"), ratio(tp + fp, n).alias("predicted_mask_rate"),
        (1 - recall).alias("residual_sensitive_rate"),
        (fp / F.greatest(fp + tn, F.lit(1))).alias("overmask_rate"))


def token_metrics(rows: DataFrame, gold: str = "labels", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return with_scores(confusion_sums(rows, gold, pred, by))


def metrics_with_total(rows: DataFrame, gold: str, pred: str, by: str) -> DataFrame:
    """Metrics per group and over all rows (group null), from one pass."""
    counted = rows.select(by, L.confusion(gold, pred).alias("c"))
    sums = counted.rollup(by).agg(*[F.sum(f"c.{n}").alias(n) for n in ("tp", "fp", "fn", "tn")])
    return with_scores(sums)


def redactor_scores(rows: DataFrame, gold: str = "labels", pred: str = "pred", by: Sequence[str] = (),
                    id_col: str = "id") -> DataFrame:
    """Token scores, exact-span scores, mean per-example and micro mask rate, accuracy."""
    # an exact-span hit is a span present in both lists of the same row
    per_row = rows.select(
        *by, L.confusion(gold, pred).alias("c"),
        L.labels_to_spans(gold).alias("g"), L.labels_to_spans(pred).alias("p"),
    ).select(*by, "c", F.size("g").alias("gs"), F.size("p").alias("ps"),
             F.size(F.array_intersect("g", "p")).alias("hits"))
    sums = per_row.groupBy(*by).agg(
        F.count(F.lit(1)).alias("examples"), *[F.sum(f"c.{n}").alias(n) for n in ("tp", "fp", "fn", "tn")],
        F.sum("gs").alias("gold_spans"), F.sum("ps").alias("pred_spans"), F.sum("hits").alias("span_tp"),
        F.avg((F.col("c.tp") + F.col("c.fp")) / F.greatest(
            F.col("c.tp") + F.col("c.fp") + F.col("c.fn") + F.col("c.tn"), F.lit(1))).alias("mean_example_mask_rate"))
    precision, recall = ratio(F.col("span_tp"), F.col("pred_spans")), ratio(F.col("span_tp"), F.col("gold_spans"))
    return with_scores(sums).select(
        "*", precision.alias("exact_span_precision"), recall.alias("exact_span_recall"),
        ratio(2 * precision * recall, precision + recall).alias("exact_span_f1"),
        F.col("predicted_mask_rate").alias("micro_mask_rate"),
        ratio(F.col("tp") + F.col("tn"), F.col("tokens")).alias("accuracy_secondary"))


def complete_methods(reviews: DataFrame) -> DataFrame:
    """Methods present in the candidates map of every row (a map names each method once)."""
    seen = reviews.select(F.explode(F.map_keys("candidates")).alias("method")).groupBy("method").agg(
        F.count(F.lit(1)).alias("rows"))
    return seen.filter(F.col("rows") == reviews.select(F.count(F.lit(1))).scalar()).select("method")


def score_methods(reviews: DataFrame, include_unreviewed: bool = False) -> DataFrame:
    """Redactor scores of every method present in all rows, against the human labels."""
    rows = reviews.filter(F.lit(include_unreviewed) | F.coalesce(F.col("human_reviewed"), F.lit(False)))
    flat = rows.select("id", F.col("human_labels").alias("gold"), F.explode("candidates").alias("method", "c"))
    kept = flat.join(complete_methods(rows), "method", "left_semi")
    return redactor_scores(kept.withColumn("pred", F.col("c.labels")), "gold", "pred", ["method"])


def split_stats(rows: DataFrame, by: Sequence[str], labels: str = "labels", task_label: str = "task_label",
                review: str | None = None) -> DataFrame:
    """Examples, tokens, selected tokens, mask rate, zero-mask examples and label histogram.

    Rolled up over ``by``: counts per label first, those rolled up per label, and at last one
    map entry per label and group.
    """
    masked = F.aggregate(labels, F.lit(0), lambda a, l: a + l)
    flat = rows.select(*by, F.col(task_label).cast("string").alias("_label"), F.size(labels).alias("_n"),
                       masked.alias("_m"), (F.col(review).cast("int") if review else F.lit(0)).alias("_r"))
    per_label = flat.groupBy(*by, "_label").agg(
        F.count(F.lit(1)).alias("examples"), F.sum("_n").alias("tokens"), F.sum("_m").alias("selected"),
        F.sum((F.col("_m") == 0).cast("bigint")).alias("zero"), F.sum("_r").alias("review"))
    sums = ("examples", "tokens", "selected", "zero", "review")
    levels = per_label.groupingSets([[*by[:k], "_label"] for k in range(len(by) + 1)], *by, "_label").agg(
        *[F.sum(n).alias(n) for n in sums], F.grouping_id().alias("_level"))
    totals = levels.groupBy(*by, "_level").agg(
        F.sum("examples").alias("examples"), F.sum("tokens").alias("tokens"), F.sum("selected").alias("selected_tokens"),
        F.sum("zero").alias("zero_mask_examples"), F.sum("review").alias("needs_review"),
        F.map_from_entries(F.collect_list(F.when(F.col("_label").isNotNull(), F.struct("_label", "examples")))).alias("task_labels"))
    return totals.select(
        *by, "examples", "tokens", "selected_tokens",
        (F.col("selected_tokens") / F.greatest("tokens", F.lit(1))).alias("mask_rate"),
        "zero_mask_examples", "needs_review", "task_labels")


def mask_statistics(rows: DataFrame, mask: str, by: Sequence[str] = ()) -> DataFrame:
    picked = F.aggregate(mask, F.lit(0), lambda a, l: a + l)
    sums = rows.select(*by, picked.alias("k"), F.size(mask).alias("n")).groupBy(*by).agg(
        F.sum("k").alias("selected_tokens"), F.sum("n").alias("total_tokens"), F.count(F.lit(1)).alias("examples"),
        F.sum((F.col("k") == 0).cast("bigint")).alias("zero_redaction_examples"))
    return sums.select(
        "*", (F.col("selected_tokens") / F.greatest("total_tokens", F.lit(1))).alias("redaction_rate"),
        (F.col("selected_tokens") / F.greatest("examples", F.lit(1))).alias("average_selected_tokens_per_example"))


def class_weight(rows: DataFrame, labels: str = "labels", most: float = 20.0) -> DataFrame:
    """min(negatives / max(positives, 1), most) in one row."""
    pos = F.sum(F.aggregate(labels, F.lit(0), lambda a, l: a + l))
    return rows.agg(pos.alias("pos"), F.sum(F.size(labels)).alias("n")).select(
        F.least((F.col("n") - F.col("pos")) / F.greatest("pos", F.lit(1)), F.lit(most)).alias("class_weight"))


def threshold_bin(score: Column) -> Column:
    """How many of THRESHOLDS the score reaches, without testing all of them.

    The grid is almost even, so a computed position is at most one off and is corrected
    against the exact neighbours.
    """
    grid = F.array(*[F.lit(t) for t in THRESHOLDS])
    guess = F.greatest(F.least(F.floor((score - 0.05) * 100).cast("int") + 1, F.lit(91)), F.lit(0))
    up = F.coalesce(F.get(grid, guess) <= score, F.lit(False)).cast("int")
    down = F.coalesce(F.get(grid, guess - 1) > score, F.lit(False)).cast("int")
    return guess + up - down


def threshold_sweep(scored: DataFrame, by: Sequence[str], gold: str = "gold", score: str = "score") -> DataFrame:
    """Metrics at all 91 thresholds from one pass: histogram per score bin, then running sums.

    After the histogram there are at most 92 rows per group.
    """
    bins = scored.select(*by, F.col(gold).cast("bigint").alias("_g"), threshold_bin(F.col(score)).alias("_bin")).groupBy(
        *by, "_bin").agg(F.sum("_g").alias("_pos"), F.count(F.lit(1)).alias("_n"))
    groups = bins.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", F.struct("_pos", "_n")))).alias("_h"),
        F.sum("_pos").alias("_P"), F.sum("_n").alias("_N"))
    grid = groups.select(*by, "_P", "_N", "_h", F.posexplode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("_i", "threshold"))
    above = lambda field: F.aggregate(
        F.map_entries("_h"), F.lit(0).cast("bigint"),
        lambda a, e: a + F.when(e["key"] > F.col("_i"), e["value"][field]).otherwise(0))
    counted = grid.select(*by, "threshold", above("_pos").alias("tp"), above("_n").alias("_pred"), "_P", "_N")
    return with_scores(counted.select(
        *by, "threshold", "tp", (F.col("_pred") - F.col("tp")).alias("fp"), (F.col("_P") - F.col("tp")).alias("fn"),
        (F.col("_N") - F.col("_P") - F.col("_pred") + F.col("tp")).alias("tn")))


def operating_points(sweep: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group the threshold with best F1, best F2 and closest mask rate (lowest threshold on ties)."""
    gap = F.abs(F.col("predicted_mask_rate") - F.col("gold_mask_rate"))
    ways = {"f1_optimized": F.col("f1"), "f2_optimized": F.col("f2"), "budget_matched": -gap}
    long = sweep.select("*", F.explode(F.array(*[
        F.struct(F.lit(name).alias("mode"), value.alias("goal")) for name, value in ways.items()])).alias("w")).select(
        *sweep.columns, "w.mode", "w.goal")
    window = Window.partitionBy(*by, "mode").orderBy(F.desc("goal"), "threshold")
    return long.withColumn("_r", F.row_number().over(window)).filter("_r = 1").drop("_r", "goal")


def at_threshold(scored: DataFrame, thresholds: DataFrame, by: Sequence[str], gold: str = "gold",
                 score: str = "score") -> DataFrame:
    """Metrics of scored tokens at given thresholds (columns by, mode, threshold) plus accuracy.

    Tokens are first reduced to counts per exact threshold interval, so the thresholds
    table multiplies a few counts per group and never the tokens.
    """
    bins = scored.select(*by, F.col(gold).cast("bigint").alias("_g"), threshold_bin(F.col(score)).alias("_bin")).groupBy(
        *by, "_bin").agg(F.sum("_g").alias("_pos"), F.count(F.lit(1)).alias("_n"))
    # a threshold taken from the grid is reached by exactly the bins above its position
    at = F.array_position(F.array(*[F.lit(t) for t in THRESHOLDS]), F.col("threshold"))
    position = F.when(at > 0, at).otherwise(F.raise_error(F.lit("threshold is not on the grid: use at_fixed_threshold")).cast("bigint"))
    wanted = thresholds.select(*by, "mode", "threshold", position.alias("_at"))
    join = bins.join(wanted, list(by))
    hit = F.col("_bin") >= F.col("_at")
    sums = join.groupBy(*by, "mode", "threshold").agg(
        F.coalesce(F.sum(F.when(hit, F.col("_pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("_n") - F.col("_pos"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~hit, F.col("_pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(~hit, F.col("_n") - F.col("_pos"))), F.lit(0)).alias("tn"))
    return with_scores(sums).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tokens")))


def at_fixed_threshold(scored: DataFrame, threshold: float, by: Sequence[str] = (), gold: str = "gold",
                       score: str = "score") -> DataFrame:
    """Metrics and accuracy of scored tokens at one given threshold."""
    g, p = F.col(gold) == 1, F.col(score) >= threshold
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    sums = scored.groupBy(*by).agg(count(g & p).alias("tp"), count(~g & p).alias("fp"),
                                   count(g & ~p).alias("fn"), count(~g & ~p).alias("tn"))
    return with_scores(sums).select(
        F.lit(threshold).alias("threshold"), "*", ratio(F.col("tp") + F.col("tn"), F.col("tokens")).alias("accuracy"))


def zero_shot_and_calibrated(validation: DataFrame, test: DataFrame, by: str, source: str,
                             gold: str = "gold", score: str = "score") -> DataFrame:
    """Test metrics per dataset at the source dataset's thresholds and at its own ones.

    ``mode`` is f1/f2/budget; ``calibration`` is ``zero_shot`` or ``target``. Thresholds
    come from validation rows only.
    """
    points = operating_points(threshold_sweep(validation, [by], gold, score), [by]).select(by, "mode", "threshold")
    fixed = points.filter(F.col(by) == source).select("mode", "threshold")
    names = points.select(by, "mode").join(fixed, "mode")
    own = at_threshold(test, points, [by], gold, score).withColumn("calibration", F.lit("target"))
    zero = at_threshold(test, names, [by], gold, score).withColumn("calibration", F.lit("zero_shot"))
    return own.unionByName(zero)
