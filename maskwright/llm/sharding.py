"""Weighted rendezvous hashing of record keys over shards, in column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import slices, sums_before, uniform
from maskwright.session import with_once


def shard_of(key: Column | Sequence[Column], weights: Sequence[float], seed: int = 11) -> Column:
    """The shard with the smallest -ln(u) / weight, u being hashed from (key, shard).

    Each shard's value depends on the key and that shard alone: a new shard, or a larger weight, only
    takes keys into that shard, and a removed shard only gives away its own. Shares follow the
    weights. A shard of weight 0 takes nothing. Null keys are one key.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative and not all zero")
    keys = [key] if isinstance(key, Column) else list(key)
    races = [F.struct((-F.log(uniform(F.lit(seed), *keys, F.lit(i))) / float(w)).alias("at"), F.lit(i).alias("shard"))
             for i, w in enumerate(weights) if w > 0]
    return (F.array_min(F.array(*races)) if len(races) > 1 else races[0])["shard"]


def shard_records(rows: DataFrame, key: Column | Sequence[Column], weights: Sequence[float], name: str = "shard") -> DataFrame:
    """rows with their shard. A map: no shuffle. A column that has the name already is replaced."""
    kept = [c for c in rows.columns if c.lower() != name.lower()]
    return with_once(rows.withColumn("__shard", shard_of(key, weights)), __once=F.col("__shard")).select(
        *[F.col(f"`{c}`") for c in kept], F.col("__once").alias(name))


def number_slots(rows: DataFrame, shard: str, order: Sequence[str], copies: str, per_slice: int = 100_000, slots: str = "slot",
                 total: int | None = None) -> DataFrame:
    """Give each record its place inside its shard, from 0 and without gaps.

    A row stands for `copies` equal records and becomes that many rows, so a record that repeats a
    billion times is one row until the end. Shards are numbered in slices of the hashed order columns,
    about per_slice rows each, so no task sorts a shard.
    """
    n = slices(rows.count() if total is None else total, per_slice)
    cut = rows.withColumn("__slice", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(n)).cast("int"))
    numbered = sums_before(cut, [shard], "__slice", [F.col(c).asc_nulls_last() for c in order], copies, "__first")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)).alias("__copy")
    return (numbered.select("*", each).withColumn(slots, F.col("__first") + F.col("__copy"))
            .drop("__slice", "__first", "__copy", copies))


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Documents over equally weighted shards by doc_id, with their slots and the shard each would get with one more.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard. A null text
    counts as empty; null ids form one key; equal rows keep separate slots of one shard. Empty input
    gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("__copies"))
    key = F.col("doc_id")
    placed = with_once(counted, shard=shard_of(key, [1.0] * shards), grown_shard=shard_of(key, [1.0] * (shards + 1)))
    placed = number_slots(placed, "shard", ["doc_id", "size", "text_crc32"], "__copies", total=documents.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
