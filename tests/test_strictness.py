"""No row may be lost in silence: misfits, gaps and strays fail or come back."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from maskwright.operators import bootstrap, corpus, metrics, perturb, robustness, rules, sampling, student, teacher, temporal
from maskwright.session import with_once
from maskwright.sources import files
from workloads.robustness import SYSTEM

FAILS = (PySparkException,)


def test_misfit_and_missing_predictions_fail(spark):
    rows = spark.createDataFrame([("a", [0, 1], [0, 1]), ("b", [0, 1], [0]), ("c", [1], None)], "id string, labels array<int>, pred array<int>")
    for bad in ("b", "c"):
        with pytest.raises(FAILS):
            metrics.token_metrics(rows.filter(F.col("id").isin("a", bad))).collect()
    assert metrics.token_metrics(rows.filter("id = 'a'")).first()["tokens"] == 2


def test_pair_without_prediction_fails(spark):
    pairs = spark.createDataFrame([("p", "s", "n", [0], [0], [1], [1], [1], None)],
                                  "pair_id string, source_id string, noise_type string, clean_target_words array<int>, target_words array<int>, "
                                  "clean_labels array<int>, labels array<int>, a array<int>, b array<int>")
    with pytest.raises(FAILS):
        robustness.score_pairs(pairs, {"x": ("a", "b")}).collect()


def test_strict_reading_survives_column_pruning(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    good = json.dumps({"id": "1", "text": "a b", "words": ["a", "b"], "labels": [0, 1]})
    path.write_text(good + "\n" + json.dumps({"id": "2", "text": "a b", "words": ["a", "b"], "labels": [0]}) + "\n")
    for read in (lambda d: d.select("text").collect(), lambda d: d.count()):
        with pytest.raises(FAILS):
            read(files.read_examples(spark, str(path)))
    path.write_text(good + "\n{broken\n")
    with pytest.raises(FAILS):
        files.read_examples(spark, str(path)).select("text").collect()
    path.write_text(good + "\n")
    assert files.read_examples(spark, str(path)).count() == 1


def test_response_lines_follow_files_and_fit_any_partition(spark, tmp_path):
    folder = tmp_path / "replies"
    folder.mkdir()
    for name, ids in (("a.jsonl", ["x", "x"]), ("b.jsonl", ["x", "zzz"]), ("c.jsonl", ["y"] * 3)):
        (folder / name).write_text("".join(json.dumps({"id": i, "model": name, "labels": [1]}) + "\n" for i in ids))
    asked = spark.createDataFrame([("x", "w", ["w"], "t"), ("y", "w", ["w"], "t")], "id string, text string, words array<string>, task_label string")
    replies = files.read_responses(spark, str(folder))
    assert sorted(r["line"] for r in replies.collect()) == list(range(7))
    accepted, rejected = teacher.validate_responses(asked, replies)
    assert {r["id"]: r["source"] for r in accepted.collect()} == {"x": "a.jsonl", "y": "c.jsonl"}
    assert sorted((r["line"], r["error"]) for r in rejected.collect()) == [
        (1, "duplicate id"), (2, "duplicate id"), (3, "unknown or missing id"), (5, "duplicate id"), (6, "duplicate id")]


def test_texts_without_words_come_back(spark):
    train = spark.createDataFrame([(str(i), f"alpha {i} beta", ["alpha", str(i), "beta"], [1, 0, 0]) for i in range(20)],
                                  "id string, text string, words array<string>, labels array<int>")
    model = student.fit_student(train, iterations=3)
    texts = spark.createDataFrame([("1", ""), ("2", "   "), ("3", "alpha 7"), ("4", None)], "id string, text string")
    got = {r["id"]: r for r in student.predict_text(model, texts, 0.5).collect()}
    assert set(got) == {"1", "2", "3", "4"} and got["1"]["words"] == [] and len(got["3"]["pred"]) == 2


def test_unknown_split_fails(spark):
    rows = spark.createDataFrame([(1, "same", "train"), (2, "same", "dev")], "source_index long, text string, desired_split string")
    with pytest.raises(FAILS):
        corpus.dedupe_across_splits(rows).collect()
    assert [r["source_index"] for r in corpus.dedupe_across_splits(rows.filter("desired_split = 'train'")).collect()] == [1]


def test_own_defects_keep_their_rows(spark):
    targets = spark.createDataFrame([(f"s{i}", "mine", "9.9", i % 2, 1, 1) for i in range(10)],
                                    "source_id string, temporal_defect string, introduced_in string, old_hit int, student_hit int, latest_hit int")
    got = {r["temporal_defect"]: r for r in temporal.by_defect(targets, 50).collect()}
    assert set(got) == {"mine", "all"} and got["mine"]["targets"] == 10 and got["mine"]["delta_low"] is not None


def test_draws_per_kind_equal_separate_draws(spark):
    flags = spark.createDataFrame([(f"s{i % 40}", "ab"[i % 2], i % 3 % 2, i % 5 % 2) for i in range(200)], "source_id string, kind string, l int, r int")
    both = {r["kind"]: r for r in bootstrap.cluster_mean_delta_by(flags, "l", "r", "kind", "all", 100).collect()}
    for kind, rows in (("a", flags.filter("kind = 'a'")), ("all", flags)):
        one = bootstrap.cluster_mean_delta(rows, "l", "r", 100).first()
        assert all(abs(one[c] - both[kind][c]) < 1e-9 for c in ("delta_low", "delta_high", "delta_mean"))


def test_ranks_for_large_caps(spark):
    rows = spark.range(6000).selectExpr("cast(id as string) as name", "case when id % 3 = 0 then null else id % 3 end as g", "id")
    for n in (0, 7, 1500):
        got = sampling.cap_rows(rows, ["g"], "name", n).groupBy("g").agg(F.count("*").alias("n"), F.max("name").alias("last")).collect()
        for r in got:
            names = sorted(str(i) for i in range(6000) if (i % 3 or None) == r["g"])
            assert r["n"] == (n or 2000) and r["last"] == names[(n or 2000) - 1]
    numbered = sampling.number_rows(rows, "name").orderBy("row_index").collect()
    assert [r["name"] for r in numbered] == sorted(str(i) for i in range(6000)) and numbered[0]["row_index"] == 0


def test_balanced_sample_takes_turns(spark):
    sizes = {"a": 3, "b": 50, "c": 9, "d": 1}
    rows = spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "id string, label string")
    for size in (0, 1, 4, 14, 17, 63, 80):
        want, left = dict.fromkeys(sizes, 0), size
        while left and any(want[k] < sizes[k] for k in sizes):
            for k in sorted(sizes):
                if left and want[k] < sizes[k]:
                    want[k] += 1
                    left -= 1
        got = {r["label"]: r["count"] for r in sampling.balanced_sample(rows, "label", size, 1).groupBy("label").count().collect()}
        assert got == {k: n for k, n in want.items() if n}, size


def test_labels_after_edit_equal_a_full_scan(spark):
    rng = random.Random(9)
    parts = ["Andrew's", "Bianca", "Velvet", "Copper", "12", "mg", "25mg", "a@b.co", "www.x.org/y", "@handle_1", "3/4/2020", "1234567", "12345-6789", "it's",
             "Silver", "Walnut,", "kg", "Miriam’s", "x\u0092y", "units", "\u0085", "—", "Phentermine"]
    texts = [rng.choice([" ", "  ", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(str(i), t, "d") for i, t in enumerate(texts)], "id string, text string, dataset_name string")
    from maskwright.functions.text import words

    labelled = with_once(rows, words=words(F.col("text")), labels=rules.rule_labels("text", SYSTEM))
    for group in ("all", "future"):
        pairs = perturb.build_pairs(labelled, group, reach=rules.reach(SYSTEM))
        both = pairs.select("text", rules.labels_after_edit("text", "clean_labels", "scan", SYSTEM).alias("near"), rules.rule_labels("text", SYSTEM).alias("full"))
        assert both.filter("near <> full").collect() == [] and both.count() > 500


def test_scores_inside_rows_equal_scores_of_words(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(str(i), [rng.choice(["alpha", "Beta9", "x", "12", "it's", "été"]) for _ in range(rng.randint(0, 9))]) for i in range(60)],
                                 "id string, words array<string>").withColumn("labels", F.transform("words", lambda w: w.rlike("[0-9]").cast("int")))
    model = student.fit_student(rows.filter("id % 2 = 0"), iterations=4, buckets=64)
    inside = {(r["id"], i): s for r in student.score_rows(model, rows).collect() for i, s in enumerate(r["scores"])}
    words = {(r["id"], r["pos"]): r["score"] for r in student.score_words(model, rows).collect()}
    assert inside.keys() == words.keys() and all(abs(inside[k] - words[k]) < 1e-9 for k in words)
