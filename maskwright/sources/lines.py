"""Lines of text files with their numbers, and JSON lines whose faults name file and line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, line, value): every line of the files, blank ones too, numbered from 1 in its file.

    A large file is read in blocks by many tasks. Spark's row ids rise inside a block, so a line's number is the
    lines of the file's earlier blocks and its place in its own. Only (file, block, count) rows are grouped
    and summed, each file's on their own, whatever the size of the blocks.
    """
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), "value")
    blocks = rows.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(starts, ["file", "_block"]).select("file", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line"), "value")


def numbered_records(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines with a fixed schema, their file and line, and the raw text in `_corrupt` where a line is broken.

    Blank lines count as lines but are no records.
    """
    lines = numbered_lines(spark, paths).filter(F.trim(F.regexp_replace("value", r"[\t\x0b\f\r]", " ")) != "")
    parsed = F.from_json("value", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select("file", "line", parsed.alias("r")).select("file", "line", "r.*")


def strict_records(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """numbered_records without faults: reading fails on a broken line with `file:line: invalid JSON`."""
    broken = F.raise_error(F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": invalid JSON: "), "_corrupt")).cast("boolean")
    return numbered_records(spark, paths, schema).filter(F.when(F.col("_corrupt").isNotNull(), broken).otherwise(True)).drop("_corrupt")
