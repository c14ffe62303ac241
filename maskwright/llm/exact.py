"""Exact deduplication: counting quotient filters find the fingerprints that repeat, bytes decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import WHITE, slices, stored
from maskwright.session import with_once


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class QuotientFilter:
    """Sorted 64-bit fingerprints with counts, stored as quotients and remainders.

    The top bits of a fingerprint (quotient) only mark one bit of `occupied`; the rest (remainder) takes
    a slot. Slots are in fingerprint order, so those of one quotient form a run whose last slot is marked in
    `ends`; a count above one takes the slot after its remainder, marked in `counters`. Nothing is lost:
    the fingerprints and counts can be read back, and filters of any size merge.
    """

    HEAD = np.dtype([("bits", "<u4"), ("wide", "<u4"), ("slots", "<u8")])

    @staticmethod
    def pack(prints: np.ndarray, counts: np.ndarray) -> bytes:
        """prints: ascending and distinct (uint64); counts: at least 1."""
        n = len(prints)
        bits = max(3, int(n).bit_length())
        rest = np.uint64(64 - bits)
        quotient = (prints >> rest).astype(np.int64)
        occupied = np.zeros(1 << bits, np.uint8)
        occupied[quotient] = 1
        many = counts > 1
        at = np.arange(n) + np.concatenate([[0], np.cumsum(many)[:-1]]) if n else np.zeros(0, np.int64)
        total = n + int(many.sum())
        slots, ends, counters = np.zeros(total, "<u8"), np.zeros(total, np.uint8), np.zeros(total, np.uint8)
        slots[at] = prints & ((np.uint64(1) << rest) - np.uint64(1))
        slots[at[many] + 1] = counts[many]
        counters[at[many] + 1] = 1
        last = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if n else np.zeros(0, bool)
        ends[at[last] + many[last]] = 1
        wide = max(1, (int(slots.max()).bit_length() + 7) // 8) if total else 1
        head = np.zeros(1, QuotientFilter.HEAD)
        head["bits"], head["wide"], head["slots"] = bits, wide, total
        body = np.ascontiguousarray(slots.view(np.uint8).reshape(-1, 8)[:, :wide])
        return head.tobytes() + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + np.packbits(counters).tobytes() + body.tobytes()

    @staticmethod
    def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints ascending, counts)."""
        head = np.frombuffer(data, QuotientFilter.HEAD, 1)[0]
        bits, wide, total = int(head["bits"]), int(head["wide"]), int(head["slots"])
        at = QuotientFilter.HEAD.itemsize

        def marks(n: int) -> np.ndarray:
            nonlocal at
            size = (n + 7) // 8
            out = np.unpackbits(np.frombuffer(data, np.uint8, size, at))[:n]
            at += size
            return out

        occupied, ends, counters = marks(1 << bits), marks(total), marks(total)
        slots = np.zeros((total, 8), np.uint8)
        slots[:, :wide] = np.frombuffer(data, np.uint8, total * wide, at).reshape(total, wide)
        slots = slots.reshape(-1).view("<u8")
        run = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64) if total else np.zeros(0, np.int64)
        quotient = np.flatnonzero(occupied)[run] if total else run
        own = np.flatnonzero(counters == 0)
        counts = np.ones(len(own), np.int64)
        after = own + 1
        has = np.zeros(len(own), bool)
        inside = after < total
        has[inside] = counters[after[inside]] == 1
        counts[has] = slots[after[has]].astype(np.int64)
        return (quotient[own].astype(np.uint64) << np.uint64(64 - bits)) | slots[own], counts

    @staticmethod
    def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and summed counts of all: sorted runs are merged, equal neighbours added up."""
        parts = [QuotientFilter.unpack(f) for f in filters]
        prints = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
        return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def repeated_fingerprints(prints: DataFrame, total: int, per_block: int = 100_000, flush: int = 2_000_000) -> DataFrame:
    """(fp, times) of the 64-bit fingerprints in column fp that occur more than once.

    Each task counts its own fingerprints in quotient filters, one per range of fingerprints, so a
    frequent one costs a single entry per task. The filters of a range meet in one task and are
    merged. A range holds about per_block fingerprints; a task holds at most `flush` before it emits.
    """
    shift = 64 - max(6, (slices(total, per_block) - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            block = (values >> np.uint64(shift)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist()
            packed = [QuotientFilter.pack(values[a:b], times[a:b]) for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True)]
            return pa.record_batch([pa.array(block[cuts]), pa.array(packed, pa.binary())], names=["block", "filter"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= flush:
                yield emit()
                held = []
        if held:
            yield emit()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        values, times = QuotientFilter.merge(rows["filter"].tolist())
        many = times > 1
        return pd.DataFrame({"fp": values[many].view(np.int64), "times": times[many]})

    filters = prints.select("fp").mapInArrow(count, "block long, filter binary")
    return filters.groupBy("block").applyInPandas(merge, "fp long, times long")


def duplicate_groups(documents: DataFrame, hot_share: float = 0.001, salts: int = 64) -> DataFrame:
    """Groups of equal normalised texts: (doc_id, fp, text_sha256, copies, keep_id, group_size).

    One row per distinct (doc_id, text); copies counts equal rows. Texts whose fingerprint occurs once
    are alone. The others are compared byte by byte: they are grouped by the whole text. A fingerprint
    with more than hot_share of all documents (so at most 1 / hot_share of them, which bounds the
    broadcast) is spread over `salts` tasks and combined there first. keep_id is the smallest doc_id,
    null if all are null.
    """
    total = documents.count()
    texts = with_once(documents.select("doc_id", "text"), norm=normal_text(F.col("text"))).drop("text")
    texts = texts.withColumn("fp", F.xxhash64("norm"))
    repeated = stored(repeated_fingerprints(texts, total))
    limit = max(100.0, hot_share * total)
    hot = F.broadcast(repeated.filter(F.col("times") > limit).select("fp", F.lit(True).alias("__hot")))
    every = F.sequence(F.lit(0), F.lit(salts - 1))

    def salted(rows: DataFrame, salt: Column) -> DataFrame:
        """rows with __salt: one of many for a hot fingerprint, 0 for others."""
        return rows.join(hot, "fp", "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(F.lit(0))).drop("__hot")

    spread = repeated.select("fp", F.explode(F.when(F.col("times") > limit, every).otherwise(F.array(F.lit(0)))).alias("__salt"))
    one = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(salts)).cast("int")
    routed = salted(texts, one).join(spread.hint("shuffle_hash"), ["fp", "__salt"], "left_semi")
    groups = (routed.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    groups = (groups.join(hot, "fp", "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0)))))
              .drop("__hot"))
    rows = (texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256"))
            .groupBy("doc_id", "fp", "text_sha256").agg(F.count("*").alias("copies")))
    joined = salted(rows, one).join(groups, ["fp", "__salt", "text_sha256"], "left")
    return joined.select("doc_id", "fp", "text_sha256", "copies", F.coalesce("keep_id", "doc_id").alias("keep_id"),
                         F.coalesce("group_size", F.lit(1)).alias("group_size"))


def exact_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts as
    empty. Of each group one row is kept, with the smallest doc_id (nulls last); of equal rows with that
    id, one. Other columns are not read; no rows give no rows.
    """
    groups = duplicate_groups(documents, **options)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")
    return groups.select("*", copy).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"), "text_sha256")


def drop_exact_duplicates(documents: DataFrame, **options) -> DataFrame:
    """The kept documents with all their columns."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    key = F.to_json(F.struct("doc_id", F.col("__sha").alias("sha")))
    keyed = with_once(documents, __sha=F.sha2(normal_text(F.col("text")), 256)).withColumn("__key", key)
    groups = duplicate_groups(documents, **options).withColumn("__key", F.to_json(F.struct("doc_id", F.col("text_sha256").alias("sha"))))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    lone = keyed.join(groups.filter(stays & (F.col("copies") == 1)).select("__key"), "__key", "left_semi")
    repeats = keyed.join(groups.filter(stays & (F.col("copies") > 1)).select("__key"), "__key", "left_semi")
    return lone.select(*columns).unionByName(repeats.dropDuplicates(["__key"]).select(*columns))
