"""Corpus preparation: cleaning, filters, duplicate removal, category limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import predicates as P
from maskwright.functions import text as X
from maskwright.operators import sampling as S
from maskwright.session import cut_lineage

SPLITS = ("train", "validation", "test")


def digest(text: Column) -> Column:
    """32-byte key of a case-folded text: grouping ships this instead of the text."""
    return F.unhex(F.sha2(X.signature(text), 256))


def load_rows(raw: DataFrame, dataset: str, text: str, label: str, index: Column, split: Column | str = "train",
              source: str | None = None, clean: bool = True) -> DataFrame:
    """Map a raw corpus to id, source_index, text, task_label, source, source_split."""
    split = F.lit(split) if isinstance(split, str) else split
    return raw.select(
        X.row_id(dataset, split, index).alias("id"), index.cast("bigint").alias("source_index"),
        (X.clean_text(F.col(text)) if clean else X.squeeze(F.col(text))).alias("text"),
        F.col(label).cast("string").alias("task_label"),
        F.lit(source or dataset).alias("source"), split.alias("source_split"))


def union_splits(frames: dict[str, DataFrame]) -> DataFrame:
    """Concatenate the splits of a corpus, each tagged with its name."""
    tagged = [df.withColumn("source_split", F.lit(name)) for name, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def keep_usable(rows: DataFrame, longest: int = 1000, spaced: bool = True) -> DataFrame:
    return rows.filter(P.usable(F.col("text"), longest, spaced))


def keep_values(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return rows.filter(F.col(column).isin(*allowed))


def map_labels(rows: DataFrame, column: str, mapping: dict[str, int]) -> DataFrame:
    """Translate labels; rows with a null or unknown label are dropped."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return rows.withColumn(column, F.try_element_at(table, F.col(column))).filter(F.col(column).isNotNull())


def keep_top_categories(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Rows of the k most frequent categories (ties broken by name).

    Counts are combined before the shuffle; the surviving list has k rows, so it is
    safe to broadcast whatever the input size.
    """
    top = rows.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(
        F.desc("count"), column).limit(k).select(column)
    return rows.join(F.broadcast(top), column, "left_semi")


def first_by_text(rows: DataFrame, order: str, text: str = "text") -> DataFrame:
    """First row of each case-folded text; ``order`` is a unique sortable column.

    The smallest order value per text is found by a combining aggregate, so copies of
    one text never gather in a task; rows are then kept by that unique value.
    """
    firsts = rows.select(digest(F.col(text)).alias("_d"), order).groupBy("_d").agg(F.min(order).alias(order))
    return rows.join(firsts.select(order), order, "left_semi")


def dedupe_across_splits(rows: DataFrame, index: str = "source_index", split: str = "desired_split") -> DataFrame:
    """Drop texts seen earlier, with train before validation before test; other split names are an error."""
    known = F.col(split).isin(*SPLITS)
    rows = rows.withColumn(split, F.when(known, F.col(split)).otherwise(F.raise_error(F.concat(
        F.lit("unknown split: "), F.coalesce(F.col(split), F.lit("null")))).cast("string")))
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col(split)).cast("bigint")
    return first_by_text(rows.withColumn("_order", F.shiftleft(rank, 56) + F.col(index)), "_order").drop("_order")


def exclude_texts(rows: DataFrame, other: DataFrame, text: str = "text", other_text: str = "text",
                  clean_other: bool = True) -> DataFrame:
    """Rows whose text does not occur in another corpus."""
    theirs = X.squeeze(F.col(other_text)) if clean_other else F.col(other_text)
    blocked = other.select(digest(theirs).alias("_d")).distinct()
    return rows.withColumn("_d", digest(F.col(text))).join(blocked, "_d", "left_anti").drop("_d")


def select_official_splits(rows: DataFrame, sizes: dict[str, int] | None, seed: int,
                           index: str = "source_index", label: str = "task_label") -> DataFrame:
    """Dedupe and sample given splits; only *chosen* earlier rows block later splits.

    With ``sizes`` None every row is chosen and this is ``dedupe_across_splits``.
    Otherwise sampling decides what blocks, so the splits are done in turn; each
    chosen set has at most ``sizes[split]`` rows.
    """
    if sizes is None:
        return dedupe_across_splits(rows, index)
    chosen = None
    for offset, split in enumerate(SPLITS):
        part = first_by_text(rows.filter(F.col("desired_split") == split), index)
        if chosen is not None:
            part = exclude_texts(part, chosen, clean_other=False)
        picked = cut_lineage(S.balanced_sample(part, label, sizes[split], seed + offset))
        chosen = picked if chosen is None else chosen.unionByName(picked)
    return chosen
