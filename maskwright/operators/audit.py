"""Joins that merge label sources and audits that explain why they do not fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import labels as L
from maskwright.functions import text as X
from maskwright.operators.metrics import confusion_sums, with_scores


def duplicate_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.groupBy(id_col).count().filter("count > 1")


def id_difference(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids on one side only: (id, side) with side ``missing`` (left only) or ``extra``.

    One combining aggregate over both id columns, so repeated ids do not multiply.
    """
    both = left.select(id_col, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(id_col, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(id_col).agg(F.max("l").alias("l"), F.max("r").alias("r")).filter("l + r = 1").select(
        id_col, F.when(F.col("l") == 1, "missing").otherwise("extra").alias("side"))


def union_checked(frames: list[DataFrame], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(union by name, duplicate ids across the inputs)."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out, duplicate_ids(out, id_col)


def require_same_ids(inputs: DataFrame, annotations: DataFrame, id_col: str = "id") -> None:
    """Raise when ids repeat or the two sides differ. Runs two small jobs."""
    for name, df in (("input", inputs), ("annotation", annotations)):
        if not duplicate_ids(df, id_col).isEmpty():
            raise ValueError(f"duplicate {name} ids")
    found = {r["side"]: r["count"] for r in id_difference(inputs, annotations, id_col).groupBy("side").count().collect()}
    if found:
        raise ValueError(f"id mismatch: missing={found.get('missing', 0)} extra={found.get('extra', 0)}")


def merge_labels(inputs: DataFrame, annotations: DataFrame, default_source: str = "unknown-teacher") -> DataFrame:
    """Inputs with labels, types, selected words and annotation source, and an ``error`` column.

    ``error`` is null for usable rows; use ``require_same_ids`` first for the strict form.
    """
    have = set(annotations.columns)
    right = annotations.select(
        "id", F.col("labels").alias("_labels"),
        (F.col("types") if "types" in have else F.lit(None).cast("array<string>")).alias("_types"),
        (F.col("source") if "source" in have else F.lit(None).cast("string")).alias("_source"))
    joined = inputs.join(right, "id")
    return joined.select(
        *inputs.columns, F.col("_labels").alias("labels"),
        F.coalesce("_types", F.transform("words", lambda _: F.lit("O"))).alias("types"),
        X.selected_words(F.col("words"), F.col("_labels")).alias("selected_words"),
        F.coalesce("_source", F.lit(default_source)).alias("annotation_source"),
        L.label_error("words", "_labels").alias("error"))


def _shared(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    right = candidate.select("id", F.col("words").alias("_words"), F.col("labels").alias("_labels"))
    joined = reference.join(right, "id")
    same = F.when(F.col("words") == F.col("_words"), F.col("_labels")).otherwise(
        F.raise_error(F.concat(F.col("id").cast("string"), F.lit(": word lists differ"))).cast("array<int>"))
    return joined.withColumn("_labels", same)


def compare_labels(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Token agreement over the shared ids, one row."""
    counts = confusion_sums(_shared(reference, candidate), "labels", "_labels")
    return with_scores(counts).withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.col("tokens")))


def disagreements(reference: DataFrame, candidate: DataFrame, n: int = 5) -> DataFrame:
    """First n shared rows (by id) whose labels differ, both rendered."""
    return _shared(reference, candidate).filter(F.col("labels") != F.col("_labels")).orderBy("id").limit(n).select(
        "id", "text", X.redact(F.col("words"), F.col("labels")).alias("reference_text"),
        X.redact(F.col("words"), F.col("_labels")).alias("candidate_text"))
