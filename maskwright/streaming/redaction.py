"""Streaming redaction and streaming duplicate removal.

The rule labels are column functions without windows or joins, so they run unchanged on
a stream; a checkpointed file sink takes the place of a resume flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.text import redact, selected_words, words
from maskwright.operators.rules import rule_labels, rules_as_of
from maskwright.operators.linear import LinearModel
from maskwright.operators.student import score_words


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.format(kind).load(path)


def redact_stream(docs: DataFrame, version: str = "1.4", replacement: str | None = "[REDACTED]") -> DataFrame:
    """Stateless: words, labels, selected words and redacted text of each document."""
    labelled = docs.select("*", words(F.col("text")).alias("words"),
                           rule_labels("text", rules_as_of(version)).alias("labels"))
    return labelled.select(
        "*", selected_words(F.col("words"), F.col("labels")).alias("selected_words"),
        redact(F.col("words"), F.col("labels"), replacement).alias("redacted"))


def score_stream(model: LinearModel, docs: DataFrame) -> DataFrame:
    """Stateless: one row per word with the student's probability."""
    return score_words(model, docs.withColumn("words", words(F.col("text"))))


def dedupe_stream(docs: DataFrame, time: str, delay: str = "1 hour", key: str = "id") -> DataFrame:
    """First row per key within the watermark; state older than the delay is dropped."""
    return docs.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def write_batches(out: DataFrame, path: str, checkpoint: str):
    """Run everything that is available into Parquet folders, one a micro-batch, and return the finished query.

    A batch that is run again after a failure replaces its own folder, so the sink holds each row once.
    """
    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")

    query = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that write_batches has put under path."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def late_rows(query) -> int:
    """Rows that the watermark has dropped from the state operators of a finished query."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def write_stream(out: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """Append to files, run everything that is available, and return the finished query."""
    query = out.writeStream.format(kind).outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
