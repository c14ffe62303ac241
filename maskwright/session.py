"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for tables that cut lineage.

    It is the one that ``spark.checkpoint.dir`` names, shared by driver and executors, so
    what it holds survives the loss of executors. Where none is named, a session that runs
    in one process gets a folder of its own and a cluster fails.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and re.fullmatch(r"local(\[.*\])?", context.master):
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Run the plan once and checkpoint it, so that later steps start from its rows."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each is computed exactly once per row.

    A projected expression may be copied into filters, inferred null checks and later
    projections. Passed through a generator it becomes a plain value that the optimizer
    leaves alone.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, in one folder for each value of partition_by."""
    folder = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
