"""JSON lines, partitioned Parquet, CSV and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.functions import labels as L
from maskwright.sources.lines import strict_records


def _label_fault() -> Column:
    return L.label_error("words", "labels")


def read_records(spark: SparkSession, paths: str | Sequence[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped.

    Strict reading fails on a broken line and names its file and number. Otherwise broken lines
    come back with the raw text in ``_corrupt`` and the file in ``_file``.
    """
    if strict:
        return strict_records(spark, paths, schema).drop("file", "line")
    reader = spark.read.schema(f"{schema}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.option("mode", "PERMISSIVE").json(paths).withColumn("_file", F.col("_metadata.file_path"))


def read_examples(spark: SparkSession, paths: str | Sequence[str], schema: str = schemas.EXAMPLE) -> DataFrame:
    """Labelled examples; reading fails where labels do not fit the words."""
    rows = read_records(spark, paths, schema)
    misfit = F.raise_error(F.concat(F.coalesce("id", F.lit("row without id")), F.lit(": "), _label_fault())).cast("boolean")
    return rows.filter(F.when(_label_fault().isNotNull(), misfit).otherwise(True))


def read_examples_lenient(spark: SparkSession, paths: str | Sequence[str], schema: str = schemas.EXAMPLE) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantined rows with an error column)."""
    rows = read_records(spark, paths, schema, strict=False)
    judged = rows.withColumn("error", F.when(F.col("_corrupt").isNotNull(), F.lit("invalid JSON")).otherwise(_label_fault()))
    return judged.filter("error is null").drop("_corrupt", "_file", "error"), judged.filter("error is not null")


def read_responses(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Labelling replies with a ``line`` that orders them by file name and place in the file.

    Spark's row numbers rise inside a block of a file; blocks are ordered by file and start,
    however they were dealt to tasks. Only the blocks' list is sorted in one task.
    """
    rows = spark.read.schema(schemas.RESPONSE).json(paths).select(
        "*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    blocks = rows.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_f", "_b", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(starts, ["_f", "_b"]).withColumn("line", F.col("_before") + F.col("_m") - F.col("_first")).drop(
        "_f", "_b", "_m", "_first", "_before")


def write_jsonl(rows: DataFrame, path: str, mode: str = "error") -> None:
    """UTF-8 JSON lines; null fields are written."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_splits(rows: DataFrame, path: str, by: Sequence[str] = ("dataset_name", "split"), mode: str = "error") -> None:
    """Partitioned Parquet: readers of one dataset and split only touch its folder.

    Rows are spread over the shuffle partitions by key and a salt from the id, so a
    large split is written by many tasks.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    rows.repartition(*[F.col(c) for c in by], salt).write.mode(mode).partitionBy(*by).parquet(path)


def write_chunks(rows: DataFrame, path: str, order: str, per_chunk: int, mode: str = "error") -> None:
    """JSON lines in folders of ``per_chunk`` rows, numbered from 1 in key order."""
    from maskwright.operators.sampling import number_rows

    numbered = number_rows(rows, order).withColumn("chunk", (F.floor(F.col("row_index") / per_chunk) + 1).cast("int"))
    numbered.drop("row_index", "total_rows").repartition("chunk").sortWithinPartitions("chunk", order).write.mode(mode).partitionBy(
        "chunk").option("ignoreNullFields", "false").json(path)


def write_result_csv(long: DataFrame, path: str, mode: str = "error") -> None:
    from maskwright.operators.reports import RESULT_COLUMNS

    long.select(*RESULT_COLUMNS).write.mode(mode).option("header", True).csv(path)


def read_reports(spark: SparkSession, glob: str, name_pattern: str = r"([a-z0-9]+)_seed(\d+)\.json$") -> DataFrame:
    """Nested robustness reports as rows, with dataset and seed taken from the file name."""
    raw = spark.read.option("multiLine", True).json(glob).select("*", F.col("_metadata.file_name").alias("_name"))
    return raw.withColumn("dataset", F.regexp_extract("_name", name_pattern, 1)).withColumn(
        "seed", F.regexp_extract("_name", name_pattern, 2).cast("int")).drop("_name")


def report_rows(reports: DataFrame, systems: Sequence[str] = ("student", "rule_or_student", "rule_and_student")) -> DataFrame:
    """Long table (dataset, seed, system, side, metrics) of nested reports."""
    fields = ("precision", "recall", "f1", "f2", "gold_mask_rate", "predicted_mask_rate", "residual_sensitive_rate", "overmask_rate", "tokens")
    entries = [F.struct(F.lit(s).alias("system"), F.lit(side).alias("side"), *[F.col(f"{s}.{side}.{f}").alias(f) for f in fields])
               for s in systems for side in ("clean", "noisy")]
    return reports.select("dataset", "seed", F.inline(F.array(*entries)))
