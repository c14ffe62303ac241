"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A run of ASCII white space, and a run of anything else.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that spark.checkpoint.dir names.

    Only a local session may leave the setting out; it then gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read it: later steps start from there,
    and the loss of an executor costs no recomputation."""
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def slices(rows: int, per_slice: int, least: int = 64) -> int:
    """How many slices keep each near per_slice rows."""
    return max(least, math.ceil(rows / per_slice))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that only depends on the keys."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def join_small(rows: DataFrame, small: DataFrame, keys: Sequence[str], salt: Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """rows joined to a table with one row per key, of which some keys hold much of rows.

    Each key is spread over `salts` parts of the join by the hash of `salt`; the small side is repeated for them.
    """
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(salt, F.lit(5)), F.lit(salts)).cast("int"))
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")


def sums_before(rows: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Add the sum of value over the rows of the same group that come before each row.

    bucket must rise with the order inside a group. Bucket totals are added up in a small table, so
    that a task sorts one bucket and never a whole group. Keys must not be null.
    """
    keys = [*group, bucket]
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.join(totals, keys)
            .withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__base"))


def repeat_rows(rows: DataFrame, copies: str, name: str, block: int = 10_000) -> DataFrame:
    """Each row `copies` times, with the number of the copy, from 0, in `name`; the column `copies` goes.

    Numbers are made in two steps, blocks and the numbers inside one, so no array is longer than `block` or
    copies / block.
    """
    last = (F.col(copies).cast("long") - 1)
    blocks = rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / block).cast("long"))))
    inside = F.sequence(F.col("__block") * block, F.least(last, F.col("__block") * block + (block - 1)))
    return blocks.withColumn(name, F.explode(inside)).drop("__block", copies)
