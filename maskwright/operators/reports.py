"""Roll-ups of metric tables over dataset, model, seed and operating point.

Input is a long metric table: one row per run with dataset, model, seed, mode and metric
columns. Those tables are small next to the corpora, but every step is still an
ordinary grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.metrics import ratio

# The columns of the exported result table, in order.
RESULT_COLUMNS = (
    "scope", "group", "dataset", "task", "teacher_policy", "model", "seed", "all_examples", "train_examples",
    "validation_examples", "test_examples", "result_source", "mode", "threshold", "precision", "recall", "f1",
    "f2", "teacher_mask_rate", "student_mask_rate", "residual_sensitive_rate", "evaluated_tokens",
)


def with_metadata(runs: DataFrame, dimension: DataFrame, key: str = "dataset") -> DataFrame:
    """Attach group, policy and domain of each dataset."""
    return runs.join(dimension, key)


def seed_repeats(runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("dataset", "model", "mode")) -> DataFrame:
    """Mean and sample deviation over seeds (null deviation for a single seed)."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seeds"), *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics])


def macro(runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model", "mode")) -> DataFrame:
    """Mean over datasets per seed, then mean and sample deviation of those means."""
    per_seed = runs.groupBy(*by, "seed").agg(F.count_distinct("dataset").alias("datasets"), *[F.avg(m).alias(m) for m in metrics])
    return per_seed.groupBy(*by).agg(
        F.max("datasets").alias("datasets"), F.count(F.lit(1)).alias("seeds"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics])


def macro_within_group(runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model", "mode")) -> DataFrame:
    """Macro means inside each policy group; groups are never averaged together."""
    per_dataset = runs.groupBy("group", *by, "dataset").agg(*[F.avg(m).alias(m) for m in metrics])
    return per_dataset.groupBy("group", *by).agg(
        F.count(F.lit(1)).alias("datasets"), *[F.avg(m).alias(m) for m in metrics])


def pooled(runs: DataFrame, weight: str, metrics: Sequence[str], by: str = "noise_type") -> DataFrame:
    """Weighted means; groups whose weights sum to zero are left out."""
    return runs.groupBy(by).agg(
        F.sum(weight).alias(weight), *[F.sum(F.col(weight) * F.col(m)).alias(f"_{m}") for m in metrics]
    ).filter(F.col(weight) > 0).select(by, weight, *[(F.col(f"_{m}") / F.col(weight)).alias(m) for m in metrics])


def arm_difference(runs: DataFrame, metrics: Sequence[str], left: str = "seen5", right: str = "clean_only",
                   by: str = "dataset", arm: str = "arm") -> DataFrame:
    """Per dataset the mean of each arm over seeds, and left - right per metric."""
    pick = lambda m, a: F.avg(F.when(F.col(arm) == a, F.col(m)))
    out = []
    for m in metrics:
        out += [pick(m, left).alias(f"{m}_{left}"), pick(m, right).alias(f"{m}_{right}"),
                (pick(m, left) - pick(m, right)).alias(f"{m}_difference")]
    return runs.groupBy(by).agg(*out)


def gate_rollup(runs: DataFrame, gates: Sequence[str], by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Per gate: all seeds pass, and how many do."""
    return runs.groupBy(*by).agg(*[c for g in gates for c in (
        F.bool_and(g).alias(f"{g}_all_seeds"), F.count_if(g).alias(f"{g}_pass_seeds"))])


def interval_verdict(delta: Column, low: Column, high: Column) -> Column:
    return (F.when(low > 0, "student").when(high < 0, "rule").when(delta == 0, "tie").otherwise("uncertain"))


def strict_verdict(gate_seeds: Column, seeds: Column, quality_seeds: Column, delta: Column, drop: Column) -> Column:
    """strict win > quality fail > mean win > rule better."""
    return (F.when(gate_seeds == seeds, "strict_win").when(quality_seeds < seeds, "quality_fail")
            .when((delta > 0) & (drop > 0), "mean_win").otherwise("rule_better"))


def best_model(runs: DataFrame, metric: str, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """The model with the highest metric; the first name wins a tie."""
    window = Window.partitionBy(*by).orderBy(F.desc(metric), "model")
    return runs.withColumn("_r", F.row_number().over(window)).filter("_r = 1").select(*by, "model", metric)


def model_analysis(runs: DataFrame, clean: str = "clean_f2", noisy: str = "noisy_f2", rule: str = "rule_noisy_f2") -> DataFrame:
    """Per model: retention, gap to the rule and number of datasets where it is best (ties count)."""
    top = F.max(noisy).over(Window.partitionBy("dataset"))
    marked = runs.withColumn("_best", (F.col(noisy) == top).cast("int"))
    return marked.groupBy("model").agg(
        F.count(F.lit(1)).alias("datasets"), F.avg(clean).alias(clean), F.avg(noisy).alias(noisy),
        F.avg(F.col(clean) - F.col(noisy)).alias("f2_drop"), F.avg(ratio(F.col(noisy), F.col(clean))).alias("retention"),
        F.avg(rule).alias(rule), (F.avg(noisy) - F.avg(rule)).alias("rule_gap"), F.sum("_best").alias("best_datasets"))


def monotonic_datasets(runs: DataFrame, metric: str, ordered_models: Sequence[str]) -> DataFrame:
    """Datasets whose metric rises strictly with model size, in one row."""
    wide = runs.groupBy("dataset").agg(*[F.max(F.when(F.col("model") == m, F.col(metric))).alias(f"m{i}")
                                         for i, m in enumerate(ordered_models)])
    rising = F.lit(True)
    for i in range(1, len(ordered_models)):
        rising = rising & (F.col(f"m{i - 1}") < F.col(f"m{i}"))
    return wide.agg(F.count(F.lit(1)).alias("datasets"), F.count_if(rising).alias("monotonic_datasets"))


def privacy_tradeoffs(runs: DataFrame) -> DataFrame:
    """Runs whose F2 threshold raises recall, F2 and mask rate over the matched budget (none lower)."""
    pick = lambda m, mode: F.max(F.when(F.col("mode") == mode, F.col(m)))
    wide = runs.groupBy("dataset", "model", "seed").agg(*[
        (pick(m, "f2_optimized") >= pick(m, "budget_matched")).alias(m) for m in ("recall", "f2", "predicted_mask_rate")])
    return wide.agg(F.count(F.lit(1)).alias("runs"),
                    F.count_if(F.col("recall") & F.col("f2") & F.col("predicted_mask_rate")).alias("privacy_tradeoff_runs"))


def wins_summary(datasets: DataFrame, seeds: int = 3) -> DataFrame:
    """Lists of mean wins, strict wins and clean passes, and totals, in one row.

    One input row per dataset: delta, drop, gate_seeds, quality_seeds, pairs, sources.
    """
    names = lambda ok: F.array_sort(F.collect_list(F.when(ok, F.col("dataset"))))
    return datasets.agg(
        names((F.col("delta") > 0) & (F.col("drop") > 0)).alias("mean_wins"),
        names(F.col("gate_seeds") == seeds).alias("strict_wins"),
        names(F.col("quality_seeds") == seeds).alias("clean_passes"),
        F.sum("pairs").alias("pairs"), F.sum("sources").alias("sources"))


def combination_table(long: DataFrame, metrics: Sequence[str], detection: str, by: str = "dataset") -> DataFrame:
    """Rows per dataset and system (rule, student, or, and) with the detection gained over the rule."""
    means = long.groupBy(by, "system").agg(*[F.avg(m).alias(m) for m in (detection, *metrics)])
    rule = F.max(F.when(F.col("system") == "rule", F.col(detection))).over(Window.partitionBy(by))
    return means.withColumn("delta_to_rule", F.col(detection) - rule)


def noise_usage(summaries: DataFrame, counts: str = "counts", by: Sequence[str] = ("stage",)) -> DataFrame:
    """Total rows per noise type from per-dataset count maps."""
    return summaries.select(*by, F.explode(counts).alias("noise_type", "n")).groupBy(*by, "noise_type").agg(F.sum("n").alias("n"))


def split_table(runs: DataFrame) -> DataFrame:
    """Split sizes per dataset and their totals (dataset null)."""
    sizes = ("all_examples", "train_examples", "validation_examples", "test_examples")
    per_dataset = runs.groupBy("dataset").agg(*[F.max(s).alias(s) for s in sizes])
    return per_dataset.rollup("dataset").agg(*[F.sum(s).alias(s) for s in sizes])


def comparison_table(runs: DataFrame, efficiency: DataFrame, teacher: str = "rule",
                     metrics: Sequence[str] = ("precision", "recall", "f1", "f2")) -> DataFrame:
    """Students next to a self-reference teacher row (all scores 1, mask rate = teacher rate), with efficiency."""
    students = seed_repeats(runs, [*metrics, "predicted_mask_rate"]).select(
        "dataset", "model", "mode", "seeds", *[f"{m}_mean" for m in (*metrics, "predicted_mask_rate")])
    self_row = runs.groupBy("dataset", "mode").agg(F.avg("gold_mask_rate").alias("predicted_mask_rate_mean")).select(
        "dataset", F.lit(teacher).alias("model"), "mode", F.lit(0).cast("bigint").alias("seeds"),
        *[F.lit(1.0).alias(f"{m}_mean") for m in metrics], "predicted_mask_rate_mean")
    return self_row.unionByName(students).join(efficiency, "model", "left")


def wide_to_long(wide: DataFrame, modes: Sequence[str], fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per mode from columns named ``<mode>_<field>``."""
    return wide.select(*keep, F.inline(F.array(*[F.struct(
        F.lit(mode).alias("mode"), *[F.col(f"{mode}_{f}").alias(f) for f in fields]) for mode in modes])))
