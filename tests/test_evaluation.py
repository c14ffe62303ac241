import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import augment as AU
from maskwright.operators import bootstrap as B
from maskwright.operators import lodo
from maskwright.operators import metrics as M
from maskwright.operators import sampling as S
from maskwright.operators import teacher as TE


def test_metrics_golden(spark):
    rows = spark.createDataFrame([("a", [0, 0, 1, 1], [0, 0, 1, 0])], "id string, labels array<int>, pred array<int>")
    got = M.redactor_scores(rows).first()
    assert (got.precision, got.recall, got.residual_sensitive_rate, got.accuracy_secondary) == (1, 0.5, 0.5, 0.75)


def flags(spark, rows):
    return spark.createDataFrame(rows, "source_id string, noise_type string, rule_clean int, rule_noisy int, student_clean int, student_noisy int")


def test_shared_survival(spark):
    got = B.shared_robustness(flags(spark, [("a", "n", 1, 0, 1, 1)]), 200).first()
    assert (got.rule_span_survival_rate, got.student_span_survival_rate, got.student_minus_rule, got.ci_low, got.ci_high) == (0, 1, 1, 1, 1)
    none = B.shared_robustness(flags(spark, [("a", "n", 0, 0, 1, 1)]), 50).first()
    assert (none.eligible_shared_clean_targets, none.student_minus_rule, none.ci_low, none.ci_high) == (0, 0, 0, 0)


def test_absolute(spark):
    got = B.absolute_robustness(flags(spark, [("a", "n", 1, 1, 1, 1), ("a", "m", 1, 0, 1, 1), ("b", "n", 1, 0, 0, 0)]), 200).first()
    assert got.target_pairs == 3 and got.unique_source_rows == 2
    assert (got.rule_clean_target_detection, got.student_clean_target_detection) == (1, pytest.approx(2 / 3))
    assert (got.rule_noisy_target_detection, got.student_noisy_target_detection) == (pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert got.student_minus_rule_noisy == pytest.approx(1 / 3)


def test_bootstrap_agrees_with_resampling(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", "n", 1, int(rng.random() < 0.5), 1, int(rng.random() < 0.7)) for i in range(400)]
    got = B.absolute_robustness(flags(spark, rows), 1000).first()
    delta = np.array([r[5] - r[3] for r in rows])
    draws = delta[rng.integers(0, 400, (4000, 400))].mean(axis=1)
    low, high = np.percentile(draws, [2.5, 97.5])
    assert got.student_minus_rule_noisy_low == pytest.approx(low, abs=0.015)
    assert got.student_minus_rule_noisy_high == pytest.approx(high, abs=0.015)


def test_weights_have_mean_and_variance_one(spark):
    totals = spark.range(200).select(F.col("id").cast("string").alias("cluster"), F.lit(1).alias("n"))
    got = B.bootstrap_sums(totals, ["n"], 500, 9).filter("repeat >= 0").agg(F.avg("n"), F.variance("n")).first()
    assert got[0] == pytest.approx(200, abs=3) and got[1] == pytest.approx(200, rel=0.2)


def test_sweep_matches_direct_counts(spark):
    rng = np.random.default_rng(2)
    scores = list(rng.random(500)) + list(M.THRESHOLDS[:20]) + [0.0, 1.0]
    rows = [("m", int(rng.random() < s), float(s)) for s in scores]
    got = {r.threshold: (r.tp, r.fp) for r in M.threshold_sweep(spark.createDataFrame(rows, "model string, gold int, score double"), ["model"]).collect()}
    assert len(got) == 91
    for t in M.THRESHOLDS:
        assert got[t] == (sum(g for _, g, s in rows if s >= t), sum(1 - g for _, g, s in rows if s >= t))


def test_rank_and_samples_on_a_hot_group(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("g"))
    ranked = S.rank_in_group(S.keyed(rows, 1), ["g"], "_key", "id").collect()
    groups = {}
    for r in ranked:
        groups.setdefault(r.g, []).append(r)
    for members in groups.values():
        ordered = sorted(members, key=lambda r: (r._key, r.id))
        assert [r.rank for r in ordered] == list(range(1, len(ordered) + 1)) and ordered[0].group_size == len(ordered)
    big = S.first_n(S.keyed(rows, 1), ["g"], "_key", "id", 1500)
    assert {r["g"]: r["count"] for r in big.groupBy("g").count().collect()}[-1] == 1500


def test_evenly_spaced(spark):
    rows = spark.range(103).select((F.col("id") * 7 + 2).alias("x"))
    for k in (1, 2, 10, 102, 103, 500):
        want = {int(i) for i in np.linspace(0, 102, k, dtype=int)} if k < 103 else set(range(103))
        assert {(r.x - 2) // 7 for r in S.evenly_spaced(rows, "x", k).collect()} == want, k


def test_balanced_augmentation_levels_the_noise_types(spark):
    rows = []
    for i in range(300):
        allowed = ["double_space", "comma_after_number", "dosage_join"][: 1 + i % 3]
        rows += [(i, n) for n in allowed]
    made = spark.createDataFrame(rows, "id long, noise_type string")
    got = {r.noise_type: r["count"] for r in AU.select_balanced(made, 1).groupBy("noise_type").count().collect()}
    assert got == {"double_space": 100, "comma_after_number": 100, "dosage_join": 100}
    two = AU.select_balanced(made, 2)
    assert two.groupBy("id").count().agg(F.max("count")).first()[0] == 2 and two.count() == 500


def test_lodo_rejects_bad_tasks(spark):
    rows = spark.createDataFrame([("a", "train"), ("b", "train")], "dataset_name string, split string")
    assert {(r.heldout, r.n) for r in lodo.lodo_counts(rows, ["a", "b"]).collect()} == {("a", 1), ("b", 1)}
    for tasks in (["a", "a"], ["a"]):
        with pytest.raises(ValueError):
            lodo.lodo_splits(rows, tasks)


def test_responses(spark):
    asked = spark.createDataFrame([("a", "x y", ["x", "y"], "0"), ("b", "z", ["z"], "1"), ("c", "q", ["q"], "1")], "id string, text string, words array<string>, task_label string")
    replies = spark.createDataFrame([
        ("a", 1, "m", None, '```json\n{"labels": [0, true]}\n```', None, None), ("a", 2, "m", None, '```json\n{"labels": [0, 1]}\n```', None, None),
        ("a", 3, None, "[1,1]", None, None, None), ("b", 4, None, None, None, "[1, 0]", None), ("x", 5, None, "[1]", None, None, None)],
        "id string, line int, model string, labels string, response string, output string, content string")
    accepted, rejected = TE.validate_responses(asked, replies)
    assert [(r.id, r.labels) for r in accepted.collect()] == [("a", [0, 1])]
    assert {(r.id, r.line, r.error) for r in rejected.collect()} == {
        ("a", 1, "every label must be integer 0 or 1"), ("a", 3, "duplicate id"), ("b", 4, "expected 1 labels, got 2"),
        ("x", 5, "unknown or missing id"), ("c", None, "missing response")}
