import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import leakage as LK
from maskwright.operators import perturb as N
from maskwright.operators import rules as R
from maskwright.plans import jobs as J
from maskwright.sources import tables as T
from tests.conftest import SMALL

digits = lambda df: df.select("id", F.transform("words", lambda w: w.rlike(r"\p{Nd}").cast("int")).alias("labels"))


def test_corpus_to_splits(spark):
    raw = T.table(spark, SMALL, "documents")
    rows = J.prepare_corpus(raw, "docs", "text", "lang", "doc_id", longest=2000)
    assert rows.groupBy(F.lower("text")).count().filter("count > 1").count() == 0
    labels = rows.select("id", R.rule_labels("text").alias("labels"))
    merged = J.merge_and_split(rows, labels)
    assert merged.filter("error is not null").count() == 0
    total = J.split_report(merged).filter("dataset_name is null").first()
    assert total.examples == rows.count() and sum(total.task_labels.values()) == total.examples
    with pytest.raises(ValueError):
        J.merge_and_split(rows, labels.limit(3))


def test_robustness_replay_and_leakage(spark):
    notes = T.order_notes(spark, SMALL).limit(120)
    rows = notes.select("*", X.words(F.col("text")).alias("words"), R.rule_labels("text").alias("labels"))
    out = J.augment_training(rows, 1)
    assert out.filter("augmentation.group = 'seen'").count() == N.variants(rows, N.noises("seen"), ["id"]).select("id").distinct().count()
    pairs = N.build_pairs(rows, "unseen")
    summary, gates, scored = J.evaluate_robustness(pairs, digits, repeats=60)
    assert summary.first().pairs == pairs.count() and gates.count() == 6
    both = scored.agg(F.min(F.col("or_noisy") - F.greatest("rule_noisy", "student_noisy")), F.max(F.col("and_noisy") - F.least("rule_noisy", "student_noisy"))).first()
    assert both[0] >= 0 and both[1] <= 0
    replay = {r.temporal_defect: r for r in J.replay_rules(notes, R.CLINICAL_DEFECTS + R.BIOGRAPHY_DEFECTS, "1.3", "1.4", digits, None, 60).collect()}
    assert replay["email"].past_rule_detection == 0 and replay["long_identifier"].past_rule_detection == 1
    assert replay["all"].targets == sum(r.targets for k, r in replay.items() if k != "all")
    masked = rows.withColumn("pred", F.col("labels"))
    answer = lambda t: LK.with_original_answer(t.select("id", "condition", "trial", F.lit(0).alias("gold"), (F.length("text") % 2).alias("predicted"), F.lit(0.5).alias("p_gold")))
    table = {r.condition: r for r in J.measure_leakage(masked, answer, 3).collect()}
    assert table["original"].accuracy_drop == 0 and table["random_teacher_budget"].trials == 3


def test_unknown_split_names_are_refused(spark):
    rows = spark.createDataFrame([("a", "x y", ["x", "y"], "train"), ("b", "x", ["x"], "dev")], "id string, text string, words array<string>, desired_split string")
    labels = rows.select("id", F.transform("words", lambda _: F.lit(0)).alias("labels"))
    with pytest.raises(ValueError, match="dev"):
        J.merge_and_split(rows, labels)
    assert J.merge_and_split(rows.filter("id = 'a'"), labels.filter("id = 'a'")).first()["split"] == "train"


def test_teacher_and_review_rounds(spark):
    notes = T.order_notes(spark, SMALL).limit(30)
    none = F.lit(None).cast("string")
    replies = notes.select("id", F.lit(0).cast("bigint").alias("line"), F.lit("m").alias("model"), none.alias("labels"),
                           F.to_json(F.struct(F.transform(X.words(F.col("text")), lambda _: F.lit(0)).alias("labels"))).alias("response"), none.alias("output"), none.alias("content"))
    asked, accepted, rejected = J.label_by_teacher(notes, "Label.", replies.limit(20))
    assert asked.count() == 30 and accepted.count() + rejected.count() == 30
    words = notes.select("id", "text", "task_label", X.words(F.col("text")).alias("words"))
    labels = lambda name, version: notes.select("id", F.lit(name).alias("method"), R.rule_labels("text", R.rules_as_of(version)).alias("labels"))
    table = J.prepare_review(words, labels("new", "1.4").unionByName(labels("old", "1.3")), ["new", "old"], "new")
    scores, progress = J.report_review(table.withColumn("human_reviewed", F.lit(True)), table.select(
        "words", "human_labels", F.col("human_labels").alias("rule_labels"), F.lit(True).alias("human_reviewed"), F.lit("d").alias("dataset")))
    assert {r["method"]: r["recall"] for r in scores.collect()}["new"] == 1.0
    assert progress.first()["reviewed"] == 30 and progress.first()["changed_from_rule"] == 0


def test_leave_one_domain_out_and_matrix(spark):
    rows = spark.createDataFrame([(f"{t}{s}{i}", t, s, ["w", "9"], [0, 1]) for t in "abc" for s in ("train", "validation", "test") for i in range(4)],
                                 "id string, dataset_name string, split string, words array<string>, labels array<int>")
    seen = []

    def fit(train):
        seen.append(sorted(r[0] for r in train.select("dataset_name").distinct().collect()))
        return lambda part: part.select("id", F.inline(F.arrays_zip("words", "labels"))).select(
            "id", F.col("labels").alias("gold"), F.when(F.col("words") == "9", 0.9).otherwise(0.1).alias("score"))

    got = J.evaluate_lodo(rows, ["a", "b", "c"], fit).collect()
    assert seen == [["b", "c"], ["a", "c"], ["a", "b"]]
    assert {(r["heldout"], r["mode"]) for r in got} == {(t, m) for t in "abc" for m in ("f1_optimized", "f2_optimized", "budget_matched")} and all(r["f2"] == 1 and r["tokens"] == 8 for r in got)
    one = "named_struct('precision', 1D, 'recall', seed / 10D, 'f1', 1D, 'f2', 1D, 'gold_mask_rate', 0.5D, 'predicted_mask_rate', 0.5D, 'residual_sensitive_rate', 0D, 'overmask_rate', 0D, 'tokens', 8)"
    nested = spark.range(4).selectExpr("concat('d', id % 2) as dataset", "cast(id + 1 as int) as seed").selectExpr("*", f"named_struct('clean', {one}, 'noisy', {one}) as student")
    per_dataset, per_group = J.summarise_matrix(nested, spark.createDataFrame([("d0", "g"), ("d1", "g")], "dataset string, group string"), ("student",))
    assert {(r["dataset"], r["mode"]): round(r["recall_mean"], 6) for r in per_dataset.collect()} == {("d0", "clean"): 0.2, ("d0", "noisy"): 0.2, ("d1", "clean"): 0.3, ("d1", "noisy"): 0.3}
    assert all(r["datasets"] == 2 and round(r["recall"], 6) == 0.25 for r in per_group.collect())
