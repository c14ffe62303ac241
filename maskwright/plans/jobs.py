"""The jobs a user calls. Each returns lazy DataFrames unless its docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import words
from maskwright.operators import (audit, augment, bootstrap, corpus, leakage, lodo, metrics, perturb, reports, review, robustness, rules,
                                  sampling, teacher, temporal)
from maskwright.session import with_once
from maskwright.sources.files import report_rows
from maskwright.sources.resume import with_cache


def prepare_corpus(raw: DataFrame, dataset: str, text: str, label: str, index: str, longest: int,
                   split: str | None = None, exclude: DataFrame | None = None, sizes: dict[str, int] | None = None,
                   sample: int | None = None, seed: int = 42) -> DataFrame:
    """Raw rows to cleaned, usable, deduplicated, sampled and split rows with words.

    ``longest`` is the length filter of the corpus in characters; longer rows are not usable.
    """
    rows = corpus.load_rows(raw, dataset, text, label, F.col(index), F.col(split) if split else "train")
    rows = corpus.keep_usable(rows, longest).filter(F.col("task_label").isNotNull())
    if exclude is not None:
        rows = corpus.exclude_texts(rows, exclude)
    if split:
        rows = corpus.select_official_splits(rows.withColumn("desired_split", F.col("source_split")), sizes, seed)
    else:
        rows = corpus.first_by_text(rows, "source_index")
        if sample:
            rows = sampling.balanced_sample(rows, "task_label", sample, seed)
        rows = sampling.holdout_split(rows, ["task_label"], seed).withColumnRenamed("split", "desired_split")
    return rows.select("*", words(F.col("text")).alias("words"), F.lit(dataset).alias("dataset_name"))


def merge_and_split(inputs: DataFrame, annotations: DataFrame, seed: int = 42, at_least: int = 1) -> DataFrame:
    """Merge labels and split; a given desired_split is kept. Raises on id mismatch and unknown split names (small jobs)."""
    audit.require_same_ids(inputs, annotations)
    merged = audit.merge_labels(inputs, annotations)
    if "desired_split" in inputs.columns:
        kept, strange = sampling.preserve_split(merged)
        names = [r["desired_split"] for r in strange.select("desired_split").distinct().limit(5).collect()]
        if names:
            raise ValueError(f"unknown desired_split: {names}")
        return kept
    return sampling.stratified_split(merged, ["task_label"], seed, at_least=at_least)


def split_report(rows: DataFrame, by: Sequence[str] = ("dataset_name", "split")) -> DataFrame:
    return metrics.split_stats(rows, list(by))


def augment_training(rows: DataFrame, per_row: int = 1, balanced: bool = True, clean: bool = True) -> DataFrame:
    """Clean rows plus seen perturbations with projected gold labels."""
    made = perturb.variants(rows, perturb.noises("seen"), ["id"])
    chosen = augment.select_balanced(made, per_row) if balanced else augment.select_by_hash(made, per_row)
    return augment.augmented_rows(rows, chosen, clean)


def evaluate_robustness(pairs: DataFrame, student: Callable[[DataFrame], DataFrame], rule_cache: DataFrame | None = None,
                        version: str = "1.4", repeats: int = 2000, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics row, acceptance gates, scored pairs) of rule and student on clean/noisy pairs.

    ``student`` maps (id, words) rows to (id, labels); it sees each clean source once
    and each noisy text once. Rule labels come from ``rule_cache`` where present.
    """
    rule = lambda df: df.select("pair_id", rules.rule_labels("text", rules.rules_as_of(version)).alias("labels"))
    noisy_rule = with_cache(pairs, rule_cache, rule)
    clean = student(robustness.sources_to_predict(pairs).select(F.col("source_id").alias("id"), F.col("clean_words").alias("words")))
    noisy = student(pairs.select(F.col("pair_id").alias("id"), "words"))
    joined = robustness.attach_predictions(pairs, noisy_rule, "rule_noisy_labels")
    joined = robustness.attach_predictions(joined, noisy.withColumnRenamed("id", "pair_id"), "student_noisy_labels")
    joined = robustness.reuse_source_predictions(joined, clean.withColumnRenamed("id", "source_id"), "student_clean_labels")
    joined = robustness.with_combinations(joined, ("clean_labels", "rule_noisy_labels"), ("student_clean_labels", "student_noisy_labels"))
    scored = robustness.score_pairs(joined, {
        "rule": ("clean_labels", "rule_noisy_labels"), "student": ("student_clean_labels", "student_noisy_labels"),
        "or": ("or_clean_labels", "or_noisy_labels"), "and": ("and_clean_labels", "and_noisy_labels")})
    summary = bootstrap.evaluate_pairs(scored, repeats, seed)
    return summary, robustness.acceptance(summary), scored


def replay_rules(docs: DataFrame, defects: Sequence[str], old: str, latest: str, student: Callable[[DataFrame], DataFrame],
                 per_defect: int | None = None, repeats: int = 2000, seed: int = 42) -> DataFrame:
    """Per defect: what rules as of ``old`` and the student detect of what rules as of ``latest`` find.

    Every match counts unless the caller caps them with ``per_defect``.
    """
    labelled = with_once(docs, words=words(F.col("text")), old_labels=rules.rule_labels("text", rules.rules_as_of(old)),
                         latest_labels=rules.rule_labels("text", rules.rules_as_of(latest)))
    predicted = student(labelled.select("id", "words")).select("id", F.col("labels").alias("student_labels"))
    rows = labelled.join(predicted, "id")
    found = temporal.scan_candidates(rows, defects, carry=("old_labels", "latest_labels", "student_labels"))
    if per_defect:
        found = temporal.cap_candidates(found, per_defect)
    return temporal.by_defect(temporal.validated_targets(found), repeats, seed)


def measure_leakage(rows: DataFrame, attack: Callable[[DataFrame], DataFrame], trials: int = 20, seed: int = 42,
                    delete: bool = False) -> DataFrame:
    """Leakage table for teacher (labels) and student (pred) masks with rate-matched random controls."""
    texts = leakage.conditions(rows, trials, seed, None if delete else leakage.MASK_TOKEN)
    return leakage.leakage_table(leakage.leakage_scores(attack(texts)))


def label_by_teacher(rows: DataFrame, system_prompt: str, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests to send, accepted labels, rejected replies with reasons) of a round with an outside labeller."""
    asked = teacher.requests(rows.select("id", "text", words(F.col("text")).alias("words"), "task_label"), system_prompt)
    accepted, rejected = teacher.validate_responses(asked, responses)
    return asked, accepted, rejected


def prepare_review(rows: DataFrame, candidates: DataFrame, methods: Sequence[str], initialize_from: str | None = None) -> DataFrame:
    """Rows that every method has labelled, as a review table started from one method's labels."""
    return review.review_table(rows, candidates, methods, True, initialize_from)


def report_review(reviewed: DataFrame, rule_reviewed: DataFrame, dataset: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """(scores of the candidate methods against the human labels, progress of the rule review)."""
    return metrics.score_methods(reviewed), review.review_progress(rule_reviewed, dataset)


def evaluate_lodo(rows: DataFrame, tasks: Sequence[str], fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
                  task: str = "dataset_name") -> DataFrame:
    """Token metrics on each task of a model fitted without it, at thresholds of the other tasks' validation rows.

    ``fit`` maps training rows to a scorer of rows to (id, gold, score) tokens. One model is fitted per task;
    the list of tasks is the caller's.
    """
    splits = lodo.lodo_splits(rows, tasks, task)
    out = None
    for held in tasks:
        others = splits.filter(F.col("heldout") == held)
        score = fit(others.filter("split = 'train'"))
        name = F.lit(held).alias("heldout")
        validation = score(others.filter("split = 'validation'")).select(name, "gold", "score")
        test = score(rows.filter((F.col(task) == held) & (F.col("split") == "test"))).select(name, "gold", "score")
        points = metrics.operating_points(metrics.threshold_sweep(validation, ["heldout"]), ["heldout"]).select("heldout", "mode", "threshold")
        part = metrics.at_threshold(test, points, ["heldout"])
        out = part if out is None else out.unionByName(part)
    return out


def summarise_matrix(nested: DataFrame, dimension: DataFrame, systems: Sequence[str] = ("student", "rule_or_student", "rule_and_student")) -> tuple[DataFrame, DataFrame]:
    """(metrics per dataset, system and side over seeds; macro means per group) of nested robustness reports."""
    long = report_rows(nested, systems).withColumnsRenamed({"system": "model", "side": "mode"})
    scores = ("precision", "recall", "f1", "f2", "predicted_mask_rate")
    return reports.seed_repeats(long, scores), reports.macro_within_group(reports.with_metadata(long, dimension), scores)
