"""How much of the task label an attacker still reads from redacted text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.arrays import let, total
from maskwright.functions.text import redact
from maskwright.operators.metrics import ratio
from maskwright.operators.sampling import chosen_sql, drawn_sql, lexical_sql
from maskwright.session import cut_lineage, with_once

MASK_TOKEN = "[MASK]"


def conditions(rows: DataFrame, trials: int, seed: int, replacement: str | None = MASK_TOKEN,
               teacher: str = "labels", student: str = "pred", carry: Sequence[str] = ("task_label",)) -> DataFrame:
    """(id, condition, trial, text): original, teacher, student and rate-matched random masks.

    ``replacement`` None deletes masked words. All versions of a text are made in one
    pass over its row: first the masks, then one expression that shows each of them.
    """
    masks = rows.select("id", *carry, "words", F.expr(f"inline({_masks_sql(trials, seed, teacher, student)})"))
    return masks.select("id", *carry, "condition", "trial", redact(F.col("words"), F.col("mask"), replacement).alias("text"))


def condition_arrays(rows: DataFrame, trials: int, seed: int, replacement: str | None = MASK_TOKEN,
                     teacher: str = "labels", student: str = "pred", carry: Sequence[str] = ("task_label",)) -> DataFrame:
    """(id, versions): the rows of ``conditions`` still inside the row of their text, the original first.

    An attacker that is a column expression answers here, and the answer on the original text is at hand without a shuffle.
    """
    masks = with_once(rows.select("id", *carry, "words", teacher, student), _masks=F.expr(_masks_sql(trials, seed, teacher, student)))
    return masks.select("id", *carry, F.transform("_masks", lambda m: F.struct(
        m["condition"].alias("condition"), m["trial"].alias("trial"), redact(F.col("words"), m["mask"], replacement).alias("text"))).alias("versions"))


def _masks_sql(trials: int, seed: int, teacher: str, student: str) -> str:
    """array<struct<condition,trial,mask>>, the original first; random masks of both budgets share their digests."""
    blank = "transform(words, w -> 0)"
    entry = lambda name, trial, mask: f"named_struct('condition', '{name}', 'trial', {trial}, 'mask', {mask})"
    both = ", ".join(entry(f"random_{name}_budget", "trial", chosen_sql(total(mask))) for name, mask in (("teacher", teacher), ("student", student)))
    drawn = let("lex", lexical_sql(), f"flatten(transform(sequence(0, {trials - 1}), trial -> {drawn_sql(seed, f'array({both})')}))")
    fixed = ", ".join(entry(n, 0, m) for n, m in (("original", blank), ("teacher", teacher), ("student", student)))
    return f"concat(array({fixed}), {drawn})"


def with_original_answer(answers: DataFrame) -> DataFrame:
    """Add the answer on the untouched text. A window group is the versions of one text."""
    original = F.max(F.when(F.col("condition") == "original", F.col("predicted")))
    return answers.withColumn("original_predicted", original.over(Window.partitionBy("id")))


def leakage_scores(predictions: DataFrame) -> DataFrame:
    """Attacker scores per (condition, trial).

    ``predictions``: condition, trial, gold, predicted, p_gold and original_predicted (the
    attacker's answer on the untouched text). One aggregate to confusion cells does the
    heavy part and is checkpointed, as it is read more than once; everything after it has a few rows per condition.
    """
    cells = cut_lineage(predictions.groupBy("condition", "trial", "gold", "predicted").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_gold").alias("p"),
        F.sum((F.col("original_predicted") == F.col("gold")).cast("bigint")).alias("was_right"),
        F.sum((F.col("original_predicted") != F.col("predicted")).cast("bigint")).alias("changed")))
    hit = F.col("gold") == F.col("predicted")
    overall = cells.groupBy("condition", "trial").agg(
        ratio(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"),
        ratio(F.sum("p"), F.sum("n")).alias("mean_gold_label_probability"),
        F.sum("was_right").alias("originally_correct_examples"),
        ratio(F.sum(F.when(hit, F.col("was_right")).otherwise(0)), F.sum("was_right")).alias("accuracy_on_originally_correct"),
        ratio(F.sum("changed"), F.sum("n")).alias("prediction_change_rate"))
    # every cell counts for its gold class and for its predicted class
    side = lambda cls, tp: F.struct(F.col(cls).alias("cls"), tp.cast("bigint").alias("tp"), F.col("n").alias("seen"))
    sides = cells.select("condition", "trial", F.inline(F.array(
        side("gold", F.when(hit, F.col("n")).otherwise(0)), side("predicted", F.lit(0)))))
    per_class = sides.groupBy("condition", "trial", "cls").agg(ratio(2 * F.sum("tp"), F.sum("seen")).alias("f1"))
    macro = per_class.groupBy("condition", "trial").agg(F.avg("f1").alias("macro_f1"))
    return overall.join(macro, ["condition", "trial"])


LEAKAGE_FIELDS = ("accuracy", "macro_f1", "mean_gold_label_probability", "accuracy_on_originally_correct",
                  "prediction_change_rate")


def leakage_table(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over trials per condition, and the drop from the original."""
    table = scores.groupBy("condition").agg(
        F.count(F.lit(1)).alias("trials"),
        *[F.avg(f).alias(f"{f}_mean") for f in LEAKAGE_FIELDS],
        *[F.stddev_pop(f).alias(f"{f}_std") for f in LEAKAGE_FIELDS])
    base = scores.filter("condition = 'original'").agg(F.avg("accuracy")).scalar()
    return table.withColumn("accuracy_drop", base - F.col("accuracy_mean"))


def leakage_examples(texts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Original, teacher and student text with the attacker's answers side by side."""
    shown = texts.filter("trial = 0").filter(F.col("condition").isin("original", "teacher", "student"))
    joined = shown.join(predictions.filter("trial = 0").select("id", "condition", "predicted"), ["id", "condition"])
    return joined.groupBy("id").pivot("condition", ["original", "teacher", "student"]).agg(
        F.first("text").alias("text"), F.first("predicted").alias("prediction"))
