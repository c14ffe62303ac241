"""Leave-one-domain-out splits and the expected-versus-available run matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _check(tasks: Sequence[str]) -> None:
    if len(set(tasks)) != len(tasks):
        raise ValueError("tasks contain duplicates")
    if len(tasks) < 2:
        raise ValueError("leaving one domain out requires at least two tasks")


def _held_out(tasks: Sequence[str], own: str):
    return F.explode(F.filter(F.array(*[F.lit(t) for t in tasks]), lambda t: t != F.col(own)))


def lodo_splits(rows: DataFrame, tasks: Sequence[str], task: str = "dataset_name") -> DataFrame:
    """Each row once per held-out task other than its own (column heldout). A map, no join."""
    _check(tasks)
    return rows.filter(F.col(task).isin(*tasks)).select("*", _held_out(tasks, task).alias("heldout"))


def lodo_counts(rows: DataFrame, tasks: Sequence[str], task: str = "dataset_name", split: str = "split") -> DataFrame:
    """Rows per (heldout, split): counted per task first, then spread over the held-out tasks."""
    _check(tasks)
    counts = rows.filter(F.col(task).isin(*tasks)).groupBy(task, split).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(split, "n", _held_out(tasks, task).alias("heldout")).groupBy("heldout", split).agg(
        F.sum("n").alias("n"))


def missing_runs(datasets: DataFrame, available: DataFrame, models: Sequence[str], seeds: Sequence[int],
                 dataset: str = "dataset") -> DataFrame:
    """(dataset, model, seed) combinations that should exist but do not."""
    expected = datasets.select(dataset).distinct().select(
        dataset, F.explode(F.array(*[F.lit(m) for m in models])).alias("model")).select(
        "*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    return expected.join(available.select(dataset, "model", "seed").distinct(), [dataset, "model", "seed"], "left_anti")
