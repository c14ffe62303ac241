"""Nested JSON reports of any depth and any systems, as rows of their leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"([^/]+)_seed(\d+)\.json$"
LEAF = "dataset string, seed int, path array<string>, number double, flag boolean, text string"


def report_leaves(spark: SparkSession, glob: str, name: str = NAME, depth: int = 8) -> DataFrame:
    """(dataset, seed, path, number, flag, text): each scalar of each report with the keys, and places in lists, that lead to it.

    Reports are parsed as VARIANT and opened level by level, so no schema and no list of systems or fields is needed. dataset
    and seed come from the file's path; a file that does not fit the pattern, is no JSON or nests deeper than
    `depth` is an error. JSON nulls and empty containers have no leaves.
    """
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    found = lambda i: F.regexp_extract("file", name, i)
    fault = lambda text: F.raise_error(F.concat(F.lit(f"{text}: "), F.col("file")))
    tree = F.coalesce(F.try_parse_json("value"), fault("no JSON").cast("variant"))
    level = files.select(F.when(found(1) != "", found(1)).otherwise(fault("name of a report").cast("string")).alias("dataset"), found(2).cast("int").alias("seed"),
                         "file", F.array().cast("array<string>").alias("path"), tree.alias("v"))
    leaves = None
    for at in range(depth + 1):
        kind = F.schema_of_variant("v")
        judged = level.withColumn("kind", kind)
        flat = judged.filter("kind not like 'OBJECT%' and kind not like 'ARRAY%' and kind <> 'VOID'").select(
            "dataset", "seed", "path", F.when(F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("v", "$", "double")).alias("number"),
            F.when(F.col("kind") == "BOOLEAN", F.try_variant_get("v", "$", "boolean")).alias("flag"), F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string")).alias("text"))
        leaves = flat if leaves is None else leaves.unionByName(flat)
        inner = judged.filter("kind like 'OBJECT%' or kind like 'ARRAY%'")
        if at == depth:
            container = F.col("kind").like("OBJECT%") | F.col("kind").like("ARRAY%")  # in one expression, so that it is judged first
            deep = judged.filter(F.when(container, fault(f"deeper than {depth} levels").cast("boolean")).otherwise(False))
            return leaves.unionByName(deep.select("dataset", "seed", "path", F.lit(0.0).alias("number"), F.lit(True).alias("flag"), F.lit("").alias("text")))
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value").alias("w")))
        level = opened.select("dataset", "seed", "file", F.array_append("path", F.coalesce("key", F.col("pos").cast("string"))).alias("path"), F.col("w").alias("v"))


def report_metrics(leaves: DataFrame, sides: tuple[str, ...] = ("clean", "noisy")) -> DataFrame:
    """(dataset, seed, system, side, metric, value) of every system that has one of the sides."""
    fits = (F.size("path") == 3) & F.get("path", F.lit(1)).isin(*sides) & F.col("number").isNotNull()
    return leaves.filter(fits).select("dataset", "seed", F.get("path", F.lit(0)).alias("system"), F.get("path", F.lit(1)).alias("side"),
                                      F.get("path", F.lit(2)).alias("metric"), F.col("number").alias("value"))


def report_intervals(leaves: DataFrame, suffix: str = "_ci95") -> DataFrame:
    """(dataset, seed, section, name, value, low, high): each list `<name>_ci95` with the figure beside it."""
    last, before = (F.get("path", F.size("path") - i) for i in (1, 2))
    bounds = leaves.filter((F.size("path") >= 3) & F.col("number").isNotNull() & before.endswith(suffix)).select(
        "dataset", "seed", F.array_join(F.slice("path", 1, F.greatest(F.size("path") - 2, F.lit(0))), ".").alias("section"), F.regexp_replace(before, f"{suffix}$", "").alias("name"),
        F.when(last == "0", F.col("number")).alias("low"), F.when(last == "1", F.col("number")).alias("high"), F.lit(None).cast("double").alias("value"))
    points = leaves.filter((F.size("path") >= 2) & F.col("number").isNotNull()).select(
        "dataset", "seed", F.array_join(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), ".").alias("section"), last.alias("name"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.col("number").alias("value"))
    both = bounds.unionByName(points).groupBy("dataset", "seed", "section", "name").agg(F.max("value").alias("value"), F.max("low").alias("low"), F.max("high").alias("high"))
    return both.filter("low is not null or high is not null").select("dataset", "seed", "section", "name", "value", "low", "high")


def report_gates(leaves: DataFrame) -> DataFrame:
    """(dataset, seed, gate, passed) of every `pass` below `acceptance`."""
    at = lambda i: F.get("path", F.lit(i))
    return leaves.filter((F.size("path") == 3) & (at(0) == "acceptance") & (at(2) == "pass")).select("dataset", "seed", at(1).alias("gate"), F.col("flag").alias("passed"))
