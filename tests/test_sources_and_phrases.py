"""Numbered lines at any block size, output that is replaced whole, and terms of several words."""

import json
import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import phrases
from maskwright.sources import lines, publish, report_files, resume


@pytest.fixture
def block_size(spark):
    """Set the size of file blocks, and restore it."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


@pytest.mark.parametrize("size", [57, 300, 1 << 20])
def test_lines_are_numbered_in_every_block(spark, tmp_path, block_size, size):
    rng = random.Random(size)
    want = {}
    for name in ("a", "b", "empty"):
        made = ["" if rng.random() < 0.3 else f"{name}{i} " + "é" * rng.randint(0, 40) for i in range(0 if name == "empty" else 200)]
        (tmp_path / f"{name}.txt").write_text("\n".join(made) + ("\n" if name == "a" else ""), encoding="utf-8")
        want |= {(f"{name}.txt", i + 1): v for i, v in enumerate(made)}
    block_size(size)
    rows = lines.numbered_lines(spark, str(tmp_path))
    got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in rows.collect()}
    while ("b.txt", 200) not in got and want.get(("b.txt", 200)) == "":  # a last blank line without line feed is none
        del want["b.txt", 200]
    assert got == want


def test_a_broken_line_is_named_by_file_and_line(spark, tmp_path, block_size):
    made = [json.dumps({"id": i}) for i in range(60)]
    made[17:17] = ["", "   ", "{broken", "\t"]
    (tmp_path / "x.jsonl").write_text("\n".join(made) + "\n", encoding="utf-8")
    for size in (64, 1 << 20):
        block_size(size)
        rows = lines.numbered_records(spark, str(tmp_path), "id int").collect()
        assert [(r["line"], r["_corrupt"]) for r in rows if r["_corrupt"]] == [(20, "{broken")]
        assert sorted((r["line"], r["id"]) for r in rows if not r["_corrupt"]) == [(i + 1 if i < 17 else i + 5, i) for i in range(60)]
        with pytest.raises(Exception, match=r"x\.jsonl:20: invalid JSON"):
            lines.strict_records(spark, str(tmp_path), "id int").collect()


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_output_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(path).collect())
    rows = lambda n: spark.range(n)
    assert publish.manifest(spark, path) is None and publish.publish(rows(5), path, 5)
    assert not publish.publish(rows(5), path, 5) and publish.manifest(spark, path)["rows"] == 5
    failing = spark.range(1000).filter(F.when(F.col("id") == 999, F.raise_error(F.lit("killed")).cast("boolean")).otherwise(True))
    with pytest.raises(Exception, match="killed"):
        publish.publish(failing, path)
    with pytest.raises(ValueError, match="7 rows written"):
        publish.publish(rows(7), path, 8)
    assert ids() == list(range(5)) and names(tmp_path) == ["out"]
    # the output can be an input of its own successor
    assert publish.publish(spark.read.parquet(path).unionByName(spark.range(5, 7)), path, 7) and ids() == list(range(7))
    # a job that died between the renames, and one that died while it wrote
    target = publish.Folder(spark, path)
    target.move(target.beside("old-1"))
    spark.range(3).write.parquet(target.beside("new-1").path.toString())
    assert publish.manifest(spark, path)["rows"] == 7 and ids() == list(range(7)) and names(tmp_path) == ["out"]
    assert publish.publish(rows(2), path, force=True) and ids() == [0, 1]


def by_hand(words, terms, longest=5):
    low, labels, i = [w.lower() for w in words], [0] * len(words), 0
    while i < len(low):
        n = next((n for n in range(longest, 0, -1) if i + n <= len(low) and tuple(low[i:i + n]) in terms), 0)
        labels[i:i + n] = [1] * n
        i += max(n, 1)
    return labels


def test_phrases_match_longest_from_the_left(spark):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "gamma", "it's", "9", "été"]
    terms = {tuple(rng.choice(vocabulary).lower() for _ in range(rng.randint(1, 5))) for _ in range(25)} - {(w.lower(),) for w in vocabulary[:4]}
    docs = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]) for i in range(120)] + [(500, []), (501, None)]
    tokens = spark.createDataFrame(docs, "id long, words array<string>")
    table = spark.createDataFrame([(" ".join(t).upper(),) for t in terms] + [(" ".join(t),) for t in terms], "term string")
    got = {r["id"]: r for r in phrases.label_by_phrases(tokens, table).collect()}
    for i, words in docs:
        assert got[i]["labels"] == by_hand(words or [], terms), i
        runs = [(s["start"], s["stop"]) for s in got[i]["spans"]]
        assert all(a < b for a, b in runs) and all(x[1] <= y[0] for x, y in zip(runs, runs[1:], strict=False))
    assert phrases.label_by_phrases(tokens.limit(0), table).collect() == []
    assert {sum(r["labels"]) for r in phrases.label_by_phrases(tokens, table.limit(0)).collect()} == {0}
    for wrong in ("one two three four five six", "  "):
        with pytest.raises(Exception, match="no words or too many"):
            phrases.label_by_phrases(tokens, spark.createDataFrame([(wrong,)], "term string")).collect()


def test_interrupted_annotation_is_taken_up(spark, tmp_path):
    path = str(tmp_path / "out")
    inputs = spark.range(1000).select(F.format_string("k%04d", "id").alias("id"))
    label = lambda df: df.withColumn("n", F.length("id"))
    failing = lambda df: label(df.filter(F.when(F.col("id") == "k0555", F.raise_error(F.lit("killed")).cast("boolean")).otherwise(True)))
    with pytest.raises(Exception, match="killed"):
        resume.annotate_in_order(inputs.repartition(7), path, failing, per_unit=100, units_per_job=2)
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    first = files()
    assert {p.parts[1] for p in first} == {"unit=0", "unit=1", "unit=2", "unit=3"}
    assert resume.annotate_in_order(inputs, path, label, per_unit=100, units_per_job=4) == 6
    assert first.items() <= files().items() and resume.annotate_in_order(inputs, path, label, per_unit=100) == 0
    for unit in range(10):
        assert [r["id"] for r in spark.read.parquet(f"{path}/unit={unit}").collect()] == [f"k{i:04d}" for i in range(100 * unit, 100 * unit + 100)]
    with pytest.raises(ValueError, match="past the end"):
        resume.annotate_in_order(inputs.filter("id < 'k0500'"), path, label, per_unit=100)


def test_reports_of_any_depth(spark, tmp_path):
    report = {"student": {"clean": {"f2": 1, "note": "x"}, "noisy": {"f2": 0.5}}, "rule_v9": {"noisy": {"f2": 0.25}}, "runs": [{"seed": 3, "a": {"b": {"c": [1.5, None, True]}}}, {}],
              "absolute": {"drop": 0.1, "drop_ci95": [0.05, 0.2]}, "acceptance": {"gate": {"pass": True, "limit": 1}}, "none": None}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "drug_seed42.json").write_text(json.dumps(report, indent=1))
    leaves = report_files.report_leaves(spark, str(tmp_path / "in"))
    got = {".".join(r["path"]): (r["number"], r["flag"], r["text"]) for r in leaves.collect()}
    assert got["runs.0.a.b.c.0"] == (1.5, None, None) and got["runs.0.a.b.c.2"] == (None, True, None) and got["student.clean.note"] == (None, None, "x")
    assert "none" not in got and "runs.0.a.b.c.1" not in got and {(r["dataset"], r["seed"]) for r in leaves.collect()} == {("drug", 42)}
    assert {(r["system"], r["side"], r["value"]) for r in report_files.report_metrics(leaves).collect()} == {("student", "clean", 1.0), ("student", "noisy", 0.5), ("rule_v9", "noisy", 0.25)}
    assert [tuple(r)[2:] for r in report_files.report_intervals(leaves).collect()] == [("absolute", "drop", 0.1, 0.05, 0.2)]
    assert [tuple(r)[2:] for r in report_files.report_gates(leaves).collect()] == [("gate", True)]
    with pytest.raises(Exception, match="deeper than 4"):
        report_files.report_leaves(spark, str(tmp_path / "in"), depth=4).collect()
    for name, text, fault in (("x_seed1.json", "{broken", "no JSON"), ("other.json", "{}", "name of a report")):
        folder = tmp_path / name.split(".")[0]
        folder.mkdir()
        (folder / name).write_text(text)
        with pytest.raises(Exception, match=fault):
            report_files.report_leaves(spark, str(folder)).collect()
