"""Source-clustered bootstrap as one distributed aggregate.

Resampling clusters with replacement is replaced by Poisson(1) weights per cluster and
repeat. A weight depends only on (seed, cluster, repeat), so every statistic and every
noise type shares the same draw and tasks need no coordination. Weighted sums are
combined inside each task; only (groups x repeats) rows are shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

DRAWS = 12  # 20-bit draws taken from one SHA-256
BITS = 20
CLUSTERS = 512  # clusters whose weights are made at a time
GROUPS = 256  # groups whose sums a task holds


def poisson_steps() -> tuple[int, ...]:
    """Cumulative Poisson(1) probabilities scaled to 2**BITS; a weight counts the steps reached."""
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        step = round(total * 2**BITS)
        if step >= 2**BITS:
            return tuple(out)
        out.append(step)
        k += 1


def _weights(seed: int, clusters: Sequence[str | None], repeats: int) -> np.ndarray:
    """Weights of clusters (rows) in each repeat (columns).

    SHA-256 of seed, cluster and number of a block of DRAWS repeats gives that block's draws: its first 60
    hexadecimal digits are four numbers of three draws each, the last digits first.
    """
    blocks = -(-repeats // DRAWS)
    tails = [str(b).encode() for b in range(blocks)]
    digests = []
    for cluster in clusters:
        start = f"{seed}::{'' if cluster is None else f'{cluster}::'}".encode()
        digests += [hashlib.sha256(start + t).digest() for t in tails]
    parts = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)[:, :30].reshape(-1, DRAWS // 2, 5).astype(np.int32)
    even = parts[..., 0] << 12 | parts[..., 1] << 4 | parts[..., 2] >> 4
    odd = (parts[..., 2] & 15) << 16 | parts[..., 3] << 8 | parts[..., 4]
    drawn = np.stack([even, odd], axis=-1).reshape(-1, 4, 3)[:, :, ::-1].reshape(len(clusters), blocks * DRAWS)
    return _reached()[drawn[:, :repeats]]


@functools.cache
def _reached() -> np.ndarray:
    """How many of the steps each of the 2**BITS draws reaches."""
    return np.searchsorted(np.array(poisson_steps()), np.arange(1 << BITS), "right").astype(np.uint8)


def cluster_totals(rows: DataFrame, cluster: str, values: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Sum the values once per source cluster."""
    return rows.groupBy(*by, F.col(cluster).alias("cluster")).agg(*[F.sum(v).alias(n) for n, v in values.items()])


def bootstrap_sums(totals: DataFrame, names: Sequence[str], repeats: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Weighted sums per (by, repeat); repeat -1 holds the unweighted sums.

    Each task multiplies the weights of a block of clusters with their totals and adds the products up, so
    draws never become rows: what a task emits is one row for each of its groups and repeats. Cluster totals are few
    bytes but stand for ``repeats`` times the work, so they are spread over all cores first (by a hash, so that the
    exchange is not merged with the aggregate's own); a size-based coalesce would put them into one task.
    """
    spark = totals.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = totals.select(*by, F.col("cluster").cast("string").alias("cluster"), *names).repartition(tasks, F.xxhash64("cluster"))
    keys, kinds = len(by), totals.select(*by, *names).schema

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                some = np.flatnonzero(sums[:, -1])  # a repeat that draws none of the group's clusters has no row
                at = [pa.array([k] * len(some), arrow[i]) for i, k in enumerate(key)]
                yield pa.record_batch([*at, pa.array((some - 1).astype(np.int32)), *[pa.array(sums[some, i]) for i in range(len(names))]],
                                      names=[*by, "repeat", *names])
            held.clear()

        arrow = []
        for batch in batches:
            arrow = [batch.column(i).type for i in range(keys)]
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True) if keys else [()] * batch.num_rows):
                groups.setdefault(key, []).append(i)
            values = np.stack([batch.column(keys + 1 + i).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) for i in range(len(names))]
                              + [np.ones(batch.num_rows)], axis=1)
            clusters = batch.column(keys).to_pylist()
            for start in range(0, batch.num_rows, CLUSTERS):
                stop = min(start + CLUSTERS, batch.num_rows)
                weights = _weights(seed, clusters[start:stop], repeats)
                for key, members in groups.items():
                    at = np.array(members)[np.searchsorted(members, start):np.searchsorted(members, stop)]
                    if len(at):
                        sums = held.setdefault(key, np.zeros((repeats + 1, len(names) + 1)))
                        sums[0] += values[at].sum(axis=0)
                        sums[1:] += weights[at - start].T.astype(np.float64) @ values[at]
                if len(held) > GROUPS:
                    yield from emit()
        yield from emit()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields[:keys]]
    parts = spread.mapInArrow(multiply, ", ".join([*fields, "repeat int", *[f"`{n}` double" for n in names]]))
    whole = {f.name for f in kinds.fields if isinstance(f.dataType, IntegralType)}
    return parts.groupBy(*by, "repeat").agg(*[(F.round(F.sum(n)).cast("bigint") if n in whole else F.sum(n)).alias(n) for n in names])


def summarise(samples: DataFrame, points: dict[str, Column], intervals: dict[str, Column], by: Sequence[str] = (),
              means: bool = False) -> DataFrame:
    """Point values from the unweighted sums and 2.5/97.5 percentiles over the repeats, in one pass.

    ``samples`` holds groups x (repeats + 1) rows. A repeat whose denominator is zero
    gives null and is left out, as is a group without any repeat.
    """
    point = F.col("repeat") == -1
    aggregates = [F.max(F.when(point, v)).alias(n) for n, v in points.items()]
    for name, value in intervals.items():
        ci = F.percentile(F.when(~point, value), F.array(F.lit(0.025), F.lit(0.975)))
        aggregates += [ci.alias(name)] + ([F.avg(F.when(~point, value)).alias(f"{name}_mean")] if means else [])
    out = samples.groupBy(*by).agg(*aggregates)
    return out.select(*by, *points, *[c for n in intervals for c in (
        F.col(n)[0].alias(f"{n}_low"), F.col(n)[1].alias(f"{n}_high"), *([f"{n}_mean"] if means else []))])


FLAGS = ("rule_clean", "rule_noisy", "student_clean", "student_noisy")
ABSOLUTE = {
    "target_pairs": "n", "unique_source_rows": "sources",
    "rule_clean_target_detection": "rule_clean / n", "rule_noisy_target_detection": "rule_noisy / n",
    "rule_detection_drop": "(rule_clean - rule_noisy) / n", "student_clean_target_detection": "student_clean / n",
    "student_noisy_target_detection": "student_noisy / n", "student_detection_drop": "(student_clean - student_noisy) / n",
    "student_minus_rule_noisy": "(student_noisy - rule_noisy) / n",
    "student_drop_advantage": "(rule_clean - rule_noisy - student_clean + student_noisy) / n",
}


def _exprs(named: dict[str, str]) -> dict[str, Column]:
    return {name: F.expr(text) for name, text in named.items()}


def absolute_robustness(flags: DataFrame, repeats: int = 2000, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Detection of rule and student on every target, clean and noisy, with both intervals.

    ``flags`` holds source_id and 0/1 columns rule_clean, rule_noisy, student_clean, student_noisy.
    """
    totals = cluster_totals(flags, "source_id", {"n": F.lit(1), **{c: F.col(c) for c in FLAGS}}, by).withColumn("sources", F.lit(1))
    samples = bootstrap_sums(totals, ["n", "sources", *FLAGS], repeats, seed, by)
    intervals = {k: ABSOLUTE[k] for k in ("student_minus_rule_noisy", "student_drop_advantage")}
    points = summarise(samples, _exprs(ABSOLUTE), {f"{k}_ci": F.expr(v) for k, v in intervals.items()}, by)
    return points.withColumnsRenamed({f"{k}_ci_{end}": f"{k}_{end}" for k in intervals for end in ("low", "high")})


def _shared_values() -> dict[str, Column]:
    both = (F.col("rule_clean") == 1) & (F.col("student_clean") == 1)
    return {"n": both.cast("int"), "r": F.when(both, F.col("rule_noisy")).otherwise(0),
            "s": F.when(both, F.col("student_noisy")).otherwise(0)}


def _shared_summary(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    zero = lambda text: F.coalesce(F.expr(text), F.lit(0.0))
    points = {
        "eligible_shared_clean_targets": F.col("n"), "rule_span_survival_rate": zero("try_divide(r, n)"),
        "student_span_survival_rate": zero("try_divide(s, n)"), "student_minus_rule": zero("try_divide(s - r, n)")}
    return summarise(samples, points, {"ci": F.expr("try_divide(s - r, n)")}, by).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("ci_low", "ci_high")})


def shared_robustness(flags: DataFrame, repeats: int = 2000, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Survival on pairs both systems detect when clean; zeros when there are none."""
    totals = cluster_totals(flags, "source_id", _shared_values(), by)
    return _shared_summary(bootstrap_sums(totals, ["n", "r", "s"], repeats, seed, by), by)


def shared_by_noise(flags: DataFrame, noise_types: Sequence[str], repeats: int = 2000, seed: int = 42) -> DataFrame:
    """``shared_robustness`` per noise type.

    The noise types are known, so each becomes a few columns of its source's row: a
    source draws its weights once for all of them instead of once per noise type.
    """
    values, names = {}, []
    for i, noise in enumerate(noise_types):
        for key, value in _shared_values().items():
            values[f"{key}{i}"] = F.when(F.col("noise_type") == noise, value).otherwise(0)
            names.append(f"{key}{i}")
    present = flags.select("source_id", "noise_type", *FLAGS)
    samples = bootstrap_sums(cluster_totals(present, "source_id", values), names, repeats, seed)
    long = samples.select("repeat", F.inline(F.array(*[F.struct(
        F.lit(noise).alias("noise_type"), *[F.col(f"{k}{i}").alias(k) for k in ("n", "r", "s")]) for i, noise in enumerate(noise_types)])))
    return _shared_summary(long, ["noise_type"])


def f2_text(prefix: str) -> str:
    top = f"5 * {prefix}_tp"
    return f"coalesce(try_divide({top}, {top} + {prefix}_fp + 4 * {prefix}_fn), 0D)"


def paired_delta_f2(counts: DataFrame, repeats: int = 2000, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Mean and interval of student F2 - rule F2 from per-pair counts (r_tp.. and s_tp..)."""
    names = [f"{s}_{c}" for s in "rs" for c in ("tp", "fp", "fn")]
    totals = cluster_totals(counts, "source_id", {n: F.col(n) for n in names}, by)
    samples = bootstrap_sums(totals, names, repeats, seed, by)
    return summarise(samples, {}, {"delta_f2": F.expr(f"{f2_text('s')} - {f2_text('r')}")}, by, means=True)


def cluster_mean_delta(flags: DataFrame, left: str, right: str, repeats: int = 2000, seed: int = 42,
                       by: Sequence[str] = ()) -> DataFrame:
    """Interval of right - left where each cluster counts once, with its mean."""
    means = flags.groupBy(*by, F.col("source_id").alias("cluster")).agg(
        F.avg(F.col(right) - F.col(left)).alias("delta"), F.lit(1).alias("n"))
    samples = bootstrap_sums(means, ["delta", "n"], repeats, seed, by)
    return summarise(samples, {}, {"delta": F.expr("try_divide(delta, n)")}, by, means=True)


def cluster_mean_delta_by(flags: DataFrame, left: str, right: str, kind: str, total: str = "all",
                          repeats: int = 2000, seed: int = 42) -> DataFrame:
    """``cluster_mean_delta`` per kind and over all rows (kind = ``total``).

    The kinds are few and are read first (a small job), so a cluster carries one mean and
    one presence flag per kind and draws its weights once for all of them.
    """
    kinds = sorted(r[kind] for r in flags.select(kind).distinct().collect() if r[kind] is not None)
    delta = F.col(right) - F.col(left)
    cases = [F.lit(True), *[F.col(kind) == k for k in kinds]]
    means = flags.groupBy(F.col("source_id").alias("cluster")).agg(*[
        F.avg(F.when(case, delta)).alias(f"m{i}") for i, case in enumerate(cases)])
    totals = means.select("cluster", *[c for i in range(len(cases)) for c in (
        F.coalesce(F.col(f"m{i}"), F.lit(0.0)).alias(f"d{i}"), F.col(f"m{i}").isNotNull().cast("int").alias(f"n{i}"))])
    samples = bootstrap_sums(totals, [f"{k}{i}" for i in range(len(cases)) for k in "dn"], repeats, seed)
    long = samples.select("repeat", F.inline(F.array(*[F.struct(
        F.lit(name).alias(kind), F.col(f"d{i}").alias("d"), F.col(f"n{i}").alias("n")) for i, name in enumerate((total, *kinds))])))
    return summarise(long, {}, {"delta": F.expr("try_divide(d, n)")}, [kind], means=True)


def evaluate_pairs(scored: DataFrame, repeats: int = 2000, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Everything the acceptance gates need, from one pass over scored pairs.

    Every figure is a ratio of sums over sources, so one table of totals per source and
    one set of weighted sums give token quality, survival, mask rates and all intervals.
    ``scored`` is the output of ``score_pairs`` for the systems ``rule`` and ``student``.
    """
    both = (F.col("rule_clean") == 1) & (F.col("student_clean") == 1)
    values = {
        "n": F.lit(1), **{c: F.col(c) for c in FLAGS}, "both_n": both.cast("int"),
        "both_r": F.when(both, F.col("rule_noisy")).otherwise(0), "both_s": F.when(both, F.col("student_noisy")).otherwise(0),
        "kept_r": F.col("rule_clean") * F.col("rule_noisy"), "kept_s": F.col("student_clean") * F.col("student_noisy"),
        **{f"{p}_{k}": F.col(f"{column}.{k}") for p, column in (("r", "rule_n"), ("s", "student_n"), ("c", "student_c"))
           for k in ("tp", "fp", "fn", "tn")}}
    samples = bootstrap_sums(cluster_totals(scored, "source_id", values, by), list(values), repeats, seed, by)
    share = lambda top, bottom: f"coalesce(try_divide({top}, {bottom}), 0D)"
    mask = lambda p: share(f"{p}_tp + {p}_fp", f"{p}_tp + {p}_fp + {p}_fn + {p}_tn")
    points = _exprs({
        "pairs": "n", "clean_f1": share("2 * c_tp", "2 * c_tp + c_fp + c_fn"), "clean_f2": f2_text("c"),
        "clean_recall": share("c_tp", "c_tp + c_fn"), "noisy_f2": f2_text("s"), "rule_noisy_f2": f2_text("r"),
        "noisy_mask_rate": mask("s"), "rule_noisy_mask_rate": mask("r"),
        "newly_leaked": f"1 - {share('kept_s', 'student_clean')}", "rule_newly_leaked": f"1 - {share('kept_r', 'rule_clean')}",
        "shared_delta": share("both_s - both_r", "both_n"),
        "student_minus_rule_noisy": "(student_noisy - rule_noisy) / n",
        "student_drop_advantage": "(rule_clean - rule_noisy - student_clean + student_noisy) / n"})
    intervals = _exprs({
        "absolute": "(student_noisy - rule_noisy) / n", "drop_advantage": ABSOLUTE["student_drop_advantage"],
        "shared": "try_divide(both_s - both_r, both_n)", "delta_f2": f"{f2_text('s')} - {f2_text('r')}"})
    out = summarise(samples, points, intervals, by)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("shared_low", "shared_high")})
