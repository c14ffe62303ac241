import json

import pytest
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.sources import files, resume
from maskwright.streaming import redaction as ST


def write(path, lines):
    path.mkdir()
    (path / "part.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_examples_round_trip_and_quarantine(spark, tmp_path):
    good = json.dumps({"id": "a", "text": "x y", "words": ["x", "y"], "labels": [0, 1], "task_label": "1", "source": "s"})
    bad = json.dumps({"id": "b", "text": "x", "words": ["x"], "labels": [0, 1], "task_label": "1", "source": "s"})
    path = write(tmp_path / "in", [good, "", bad, "{broken"])
    fine, quarantined = files.read_examples_lenient(spark, path)
    assert [r.id for r in fine.collect()] == ["a"] and quarantined.select("error").distinct().count() == 2
    with pytest.raises(Exception):
        files.read_examples(spark, path).collect()
    files.write_jsonl(fine.withColumn("task_label", F.lit(None).cast("string")), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert json.loads(text)["task_label"] is None
    assert files.read_examples(spark, str(tmp_path / "out")).first().labels == [0, 1]


def test_resume_and_cache(spark, tmp_path):
    path = str(tmp_path / "done")
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    label = lambda df: df.withColumn("labels", F.array(F.lit(1)))
    resume.resume(rows.filter("id = 'a'"), path, label)
    resume.resume(rows, path, label)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        resume.resume(rows.filter("id = 'a'"), path, label)
    assert resume.is_complete(spark, path, 2) and not resume.write_once(label(rows), path, 2)
    pairs = spark.createDataFrame([("p",), ("q",)], "pair_id string")
    cache = spark.createDataFrame([("p", [5])], "pair_id string, labels array<int>")
    got = {r.pair_id: r.labels for r in resume.with_cache(pairs, cache, label).collect()}
    assert got == {"p": [5], "q": [1]}


def test_partitioned_splits_and_chunks(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n"), F.lit("d").alias("dataset_name"), F.when(F.col("id") < 20, "train").otherwise("test").alias("split"))
    files.write_splits(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'test'").count() == 5
    files.write_chunks(rows, str(tmp_path / "c"), "n", 10)
    assert {r.chunk: r["count"] for r in spark.read.json(str(tmp_path / "c")).groupBy("chunk").count().collect()} == {1: 10, 2: 10, 3: 5}


def test_streaming_redaction_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([("a", "mail me@x.org now"), ("b", "call 5551234567"), ("c", "nothing")], "id string, text string")
    docs.write.json(str(tmp_path / "in"))
    stream = ST.redact_stream(ST.read_stream(spark, str(tmp_path / "in"), "id string, text string"))
    ST.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.id: r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.redacted for r in ST.redact_stream(docs).collect()}
    assert got["b"] == "call [REDACTED]" and got["c"] == "nothing"


def test_streaming_dedupe(spark, tmp_path):
    rows = spark.sql("select * from values ('a', timestamp '2024-01-01 00:00:00'), ('a', timestamp '2024-01-01 00:10:00'), ('b', timestamp '2024-01-01 00:01:00') as t(id, ts)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ST.dedupe_stream(ST.read_stream(spark, str(tmp_path / "in"), "id string, ts timestamp", "parquet"), "ts")
    ST.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_schemas_parse(spark):
    for name in ("EXAMPLE", "PREPARED", "ANNOTATION", "RULE_ROW", "PAIR", "PREDICTION", "REQUEST", "RESPONSE", "REVIEW", "ENTITY_SPAN", "TEMPORAL_CANDIDATE"):
        assert spark.createDataFrame([], getattr(schemas, name)).columns
