"""Deterministic sampling and splitting.

Randomness is a SHA-256 of seed and id, so a draw does not depend on partitioning and
can be repeated anywhere. Ranks inside a group never need the whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.arrays import let
from maskwright.functions.text import stable_key
from maskwright.session import cut_lineage


#: Up to here Spark trims a ranked window's groups in each task (spark.sql.optimizer.windowGroupLimitThreshold).
FEW = 1000


def rank_in_group(rows: DataFrame, groups: Sequence[str], key: str, tie: str, rank: str = "rank",
                  size: str = "group_size", at_most: int | None = None) -> DataFrame:
    """Exact 1-based rank by (key, tie) and the group size, without gathering a group.

    ``key`` is a hex digest, hence evenly spread: its first four digits cut every
    group into 65,536 even buckets. A rank is the number of rows in lower buckets (from a
    small count table) plus the rank inside the bucket. With ``at_most``, buckets that
    start beyond that rank are dropped before any row is sorted.
    """
    bucketed = rows.withColumn("_bucket", F.substring(key, 1, 4))
    offsets = bucket_offsets(bucketed, groups, "_bucket", size)
    if at_most is not None:
        offsets = offsets.filter(F.col("_before") < at_most)
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(key, tie))
    ranked = join_offsets(bucketed, offsets, groups, "_bucket").withColumn(rank, F.col("_before") + inside)
    return (ranked if at_most is None else ranked.filter(F.col(rank) <= at_most)).drop("_bucket", "_before")


def bucket_offsets(rows: DataFrame, groups: Sequence[str], bucket: str, size: str) -> DataFrame:
    """Per group and bucket (as _g0.., _b): rows in lower buckets (_before) and in the group (size)."""
    counts = rows.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("_n"))
    per_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    lower = per_group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(bucket).alias("_b"),
        F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"), F.sum("_n").over(per_group).alias(size))


def join_offsets(rows: DataFrame, offsets: DataFrame, groups: Sequence[str], bucket: str) -> DataFrame:
    same = F.col(bucket) == F.col("_b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(offsets, same).drop("_b", *[f"_g{i}" for i in range(len(groups))])


def rank_in_order(rows: DataFrame, groups: Sequence[str], order: Sequence[str], rank: str = "rank", size: str = "group_size",
                  at_most: int | None = None) -> DataFrame:
    """Exact 1-based rank per group in the order of any sortable columns, without gathering a group.

    Rows are range partitioned and sorted by the order and checkpointed with their place,
    so that counts and ranks see the same partitions. A rank is the number of the group's
    rows in earlier partitions plus the rank inside the partition. With ``at_most``, partitions
    that start beyond that rank are left out, and rows beyond it may be.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = ranged.withColumn("_part", F.shiftright("_at", 33))
    inside = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy("_at"))
    offsets = bucket_offsets(placed, groups, "_part", size)
    if at_most is not None:
        offsets = offsets.filter(F.col("_before") < at_most)
    ranked = join_offsets(placed, offsets, groups, "_part")
    return ranked.withColumn(rank, F.col("_before") + inside).drop("_at", "_part", "_before")


def first_n(rows: DataFrame, groups: Sequence[str], key: str, tie: str, n: int, rank: str = "rank") -> DataFrame:
    """The n first rows per group, with their rank.

    A small n is trimmed in every task before anything is moved and reads its rows once; a large one is ranked by bucket.
    """
    if n <= FEW:
        window = Window.partitionBy(*groups).orderBy(key, tie)
        return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return rank_in_group(rows, groups, key, tie, rank, "_size", at_most=n).drop("_size")


def keyed(rows: DataFrame, seed: int | str, id_col: str = "id") -> DataFrame:
    return rows.withColumn("_key", stable_key(seed, F.col(id_col)))


def balanced_sample(rows: DataFrame, label: str, size: int, seed: int, id_col: str = "id") -> DataFrame:
    """Round robin over the sorted label values until ``size`` rows are taken.

    Each label's share follows from the label counts: all take part in the full rounds,
    the first labels that have more also in the last. Rows are then kept by rank, and the
    sample never meets in one task; the label counts do.
    """
    n, every = F.col("group_size"), Window.partitionBy(F.lit(1))
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("group_size"))
    lower = every.orderBy("group_size", label)
    level = (F.lit(size) - F.coalesce(F.sum(n).over(lower.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.count(F.lit(1)).over(
        lower.rowsBetween(0, Window.unboundedFollowing))
    rounds = counts.withColumn("_level", level).withColumn("_rounds", F.floor(F.max("_level").over(every)))
    left = rounds.withColumn("_left", F.lit(size) - F.sum(F.least(n, F.col("_rounds"))).over(every))
    more = (n > F.col("_rounds")).cast("int")
    turn = F.sum(more).over(every.orderBy(label).rowsBetween(Window.unboundedPreceding, 0))
    quotas = left.select(F.col(label).alias("_label"), (
        F.least(n, F.col("_rounds")) + F.when((more == 1) & (turn <= F.col("_left")), 1).otherwise(0)).alias("_quota"))
    ranked = rank_in_group(keyed(rows, seed, id_col), [label], "_key", id_col, at_most=size)
    return ranked.join(quotas, F.col(label).eqNullSafe(F.col("_label"))).filter(F.col("rank") <= F.col("_quota")).drop(
        "_key", "rank", "group_size", "_label", "_quota")


def _share(n: Column, fraction: float) -> Column:
    return F.bround(n * F.lit(fraction)).cast("bigint")


def stratified_split(rows: DataFrame, strata: Sequence[str], seed: int, validation: float = 0.1,
                     test: float = 0.1, at_least: int = 1, id_col: str = "id") -> DataFrame:
    """Add ``split``: per stratum round-half-even shares for validation and test, rest train."""
    ranked = rank_in_group(keyed(rows, seed, id_col), strata, "_key", id_col)
    n_val = F.greatest(F.lit(at_least), _share(F.col("group_size"), validation))
    n_test = F.greatest(F.lit(at_least), _share(F.col("group_size"), test))
    return ranked.withColumn("split", F.when(F.col("rank") <= n_val, "validation").when(
        F.col("rank") <= n_val + n_test, "test").otherwise("train")).drop("_key", "rank", "group_size")


def holdout_split(rows: DataFrame, strata: Sequence[str], seed: int, held: float = 0.2,
                  test_share: float = 0.5, id_col: str = "id") -> DataFrame:
    """Nested hold-out: ``held`` of each stratum, of which ``test_share`` becomes test."""
    ranked = rank_in_group(keyed(rows, seed, id_col), strata, "_key", id_col)
    n_held = _share(F.col("group_size"), held)
    n_test = _share(n_held, test_share)
    return ranked.withColumn("split", F.when(F.col("rank") <= n_test, "test").when(
        F.col("rank") <= n_held, "validation").otherwise("train")).drop("_key", "rank", "group_size")


def preserve_split(rows: DataFrame, column: str = "desired_split") -> tuple[DataFrame, DataFrame]:
    """(rows with their given split, rows whose split name is unknown)."""
    known = F.coalesce(F.col(column).isin("train", "validation", "test"), F.lit(False))
    return rows.filter(known).withColumn("split", F.col(column)), rows.filter(~known)


def exact_per_class(rows: DataFrame, label: str, size: int, seed: int, id_col: str = "id") -> DataFrame:
    """size/2 rows of each class of a two-class label."""
    if size % 2:
        raise ValueError("size must be even")
    return first_n(keyed(rows, seed, id_col), [label], "_key", id_col, size // 2).drop("_key", "rank")


def light_heavy_sample(rows: DataFrame, masked: str, count: int, seed: int, by: Sequence[str] = (),
                       id_col: str = "id") -> DataFrame:
    """Half from rows with 1-3 masked words, half from rows with 4 or more, topped up from the rest.

    Only the first 2*count rows of each weight class can be picked, so everything after
    the first step works on that bounded candidate set.
    """
    positive = keyed(rows.filter(F.col(masked) > 0), seed, id_col).withColumn(
        "_light", (F.col(masked) <= 3).cast("int"))
    pool = first_n(positive, [*by, "_light"], "_key", id_col, 2 * count, "_rank")
    half = count // 2
    chosen = F.col("_rank") <= F.when(F.col("_light") == 1, half).otherwise(count - half)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    marked = pool.withColumn("_chosen", chosen.cast("int")).withColumn("_taken", F.sum("_chosen").over(group))
    rest = Window.partitionBy(*by, "_chosen").orderBy("_key", id_col)
    return marked.withColumn("_extra", F.row_number().over(rest)).filter(
        (F.col("_chosen") == 1) | (F.col("_extra") <= count - F.col("_taken"))
    ).drop("_key", "_light", "_rank", "_chosen", "_taken", "_extra")


def per_outcome_sample(rows: DataFrame, by: Sequence[str], per_outcome: int, seed: int, id_col: str = "id") -> DataFrame:
    """Up to ``per_outcome`` rows per outcome, with the fixed outcome order for display."""
    # Errors first.
    order = ("missed", "overmask", "missed+overmask", "agreement", "truncated")
    picked = first_n(keyed(rows, seed, id_col), [*by, "outcome"], "_key", id_col, per_outcome)
    return picked.withColumn(
        "outcome_order", F.array_position(F.array(*[F.lit(o) for o in order]), F.col("outcome")).cast("int")).drop("_key")


def cap_rows(rows: DataFrame, groups: Sequence[str], order: str, n: int, part: int = 64) -> DataFrame:
    """First n rows per group in input order; 0 keeps all.

    No n-th row of a group comes after the n-th of any part of it. The rows of one in ``part``
    order values (by hash) give that bound, and only rows up to it are stored and ranked: about
    ``part`` times n a group. A group with fewer than n rows in the part is ranked whole.
    """
    if n == 0:
        return rows
    some = cut_lineage(rows.select(*groups, order).filter(F.pmod(F.xxhash64(order), F.lit(part)) == 0))
    last = rank_in_order(some, groups, [order], "_rank", "_size").filter(F.col("_rank") == n).select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(order).alias("_last"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    near = rows.join(last, same, "left").filter(
        F.col("_last").isNull() | F.col(order).isNull() | (F.col(order) <= F.col("_last"))).select(*rows.columns)
    ranked = rank_in_order(cut_lineage(near), groups, [order], "_rank", "_size", n)
    return ranked.filter(F.col("_rank") <= n).drop("_rank", "_size")


def sample_n(rows: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """The n first rows in digest order."""
    return first_n(keyed(rows, seed, id_col), [], "_key", id_col, n).drop("_key", "rank")


def number_rows(rows: DataFrame, order: str) -> DataFrame:
    """Global 0-based ``row_index`` by a unique order column of any sortable type, and ``total_rows``."""
    return rank_in_order(rows, [], [order], "row_index", "total_rows").withColumn("row_index", F.col("row_index") - 1)


def evenly_spaced(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Rows at positions floor(i*(n-1)/(k-1)), i = 0..k-1, of the ordered set (all rows when k >= n)."""
    numbered = number_rows(rows, order)
    n, r, steps = F.col("total_rows"), F.col("row_index"), max(k - 1, 1)
    # the only i that can land on row r is the first one with i*(n-1)/(k-1) >= r
    i = F.floor((r * steps + n - 2) / F.greatest(n - 1, F.lit(1))).cast("bigint")
    lands = F.expr("row_index") == F.floor(i * (n - 1) / steps).cast("bigint")
    return numbered.filter((n <= k) | ((i <= k - 1) & lands)).drop("row_index", "total_rows")


def random_mask_sql(budget: str, seed: int, lexical_only: bool = True, id_col: str = "id") -> str:
    """A mask over ``words`` for ``trial`` with ``budget`` words at random positions.

    Positions are ordered by digest and cut at the budget; the cut is a digest value,
    so marking the chosen words takes one pass.
    """
    return let("lex", lexical_sql(lexical_only), drawn_sql(seed, chosen_sql(budget), id_col))


def lexical_sql(lexical_only: bool = True) -> str:
    """Which of the ``words`` may be drawn."""
    eligible = r"rlike(w, '[\\p{L}\\p{N}]')" if lexical_only else "true"
    return f"transform(words, w -> {eligible})"


def drawn_sql(seed: int, body: str, id_col: str = "id") -> str:
    """``body`` over the digests ``h`` of the drawable words of ``trial`` and over them in order, ``ordered``.

    Neither depends on a budget, so masks of several budgets share them.
    """
    hashes = "transform(lex, (may, i) -> case when may then sha2(concat(stem, i), 256) end)"
    stem = f"concat_ws('::', '{seed}', trial, {id_col}, '')"
    return let("stem", stem, let("h", hashes, let("ordered", "sort_array(filter(h, x -> x is not null))", body)))


def chosen_sql(budget: str) -> str:
    cut = f"get(ordered, least({budget}, size(ordered)) - 1)"
    return let("top", cut, "transform(h, x -> cast(coalesce(x <= top, false) as int))")


def random_masks(rows: DataFrame, budget: str, trials: int, seed: int, lexical_only: bool = True,
                 id_col: str = "id") -> DataFrame:
    """Per trial (column trial) a random mask with as many words as ``budget`` (an SQL expression)."""
    per_trial = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    return per_trial.withColumn("mask", F.expr(random_mask_sql(budget, seed, lexical_only, id_col)))
