"""Completeness, resume and prediction caches on top of Spark's commit protocol."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.publish import publish


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def is_complete(spark: SparkSession, path: str, expected: int) -> bool:
    """True when the committed output holds the expected number of rows (footer counts only)."""
    done = _read_or_none(spark, path)
    return done is not None and done.count() == expected


def write_once(rows: DataFrame, path: str, expected: int) -> bool:
    """Write unless a complete output exists. A job that dies half way leaves an older output whole (``publish``)."""
    if is_complete(rows.sparkSession, path, expected):
        return False
    return publish(rows, path, expected, force=True)


def pending(inputs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Inputs without an output row."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def unknown(inputs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Output keys that are no longer part of the input."""
    return done.select(key).join(inputs.select(key), key, "left_anti")


def resume(inputs: DataFrame, path: str, annotate: Callable[[DataFrame], DataFrame], key: str = "id") -> None:
    """Annotate and append only the inputs that the output lacks."""
    spark = inputs.sparkSession
    done = _read_or_none(spark, path)
    if done is None:
        annotate(inputs).write.parquet(path)
        return
    if not unknown(inputs, done, key).isEmpty():
        raise ValueError("resume output contains ids absent from current input")
    annotate(pending(inputs, done, key)).write.mode("append").parquet(path)


def with_cache(pairs: DataFrame, cache: DataFrame | None, predict: Callable[[DataFrame], DataFrame],
               key: str = "pair_id") -> DataFrame:
    """(key, labels) for every pair: cached where present, predicted otherwise."""
    if cache is None:
        return predict(pairs).select(key, "labels")
    wanted = cache.join(pairs.select(key), key, "left_semi").select(key, "labels")
    return wanted.unionByName(predict(pending(pairs, cache, key)).select(key, "labels"))


def reconcile(inputs: DataFrame, outputs: DataFrame, key: str = "id") -> DataFrame:
    """One row: input rows, output rows, distinct keys of both."""
    both = inputs.select(key, F.lit("in").alias("side")).unionByName(outputs.select(key, F.lit("out").alias("side")))
    per_key = both.groupBy(key).agg(F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "out").alias("o"))
    return per_key.agg(F.sum("i").alias("inputs"), F.sum("o").alias("outputs"), F.count_if(F.expr("o = 0")).alias("missing"),
                       F.count_if(F.expr("i = 0")).alias("unknown"), F.count_if(F.expr("o > 1")).alias("repeated"))


def annotate_in_order(inputs: DataFrame, path: str, annotate: Callable[[DataFrame], DataFrame], key: str = "id", per_unit: int = 100_000,
                      units_per_job: int = 64) -> int:
    """Annotate inputs into Parquet under path, in the order of a unique key, and take up again where a job was stopped.

    Rows are numbered by key and cut into units of per_unit. A job writes the next units_per_job units, each to its own
    folder `unit=<n>`, with its rows in order, and replaces what those folders hold (dynamic partition overwrite). A
    unit is done when its folder has the number and the hash of its keys; a changed input so redoes the units that
    differ, and units past its end are an error. Returns the number of units written.
    """
    from maskwright.operators.sampling import number_rows
    from maskwright.session import cut_lineage

    spark = inputs.sparkSession
    unit = F.floor(F.col("row_index") / per_unit).cast("int")
    numbered = cut_lineage(number_rows(inputs, key).withColumn("unit", unit).drop("row_index", "total_rows"))
    sums = (F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(key)).alias("keys"))
    expected = cut_lineage(numbered.groupBy("unit").agg(*sums))
    count = 0
    while True:
        done = _read_or_none(spark, path)
        left = expected
        if done is not None:
            have = done.groupBy("unit").agg(*sums)
            if not have.join(expected, "unit", "left_anti").isEmpty():
                raise ValueError("output holds units past the end of the current input")
            left = expected.join(have, ["unit", "rows", "keys"], "left_anti")
        units = [r["unit"] for r in left.orderBy("unit").limit(units_per_job).collect()]
        if not units:
            return count
        part = numbered.filter(F.col("unit").isin(units))
        annotated = annotate(part.drop("unit")).join(part.select(key, "unit"), key)
        annotated.repartition("unit").sortWithinPartitions("unit", key).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("unit").parquet(path)
        count += len(units)
