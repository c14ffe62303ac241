"""A logistic model over hashed features as a table of weights, trained in epochs by gradients that tasks sum up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from maskwright.operators.metrics import with_scores
from maskwright.session import cut_lineage, written

#: The intercept's bucket.
INTERCEPT = -1
#: Rows of a step's sums that are no gradient.
LOSS, MASS = -2, -3
#: Weight tables up to this size are looked up inside the task; larger ones are joined.
IN_TASK = 1 << 20


def bucket_sql(feature: str, buckets: int) -> str:
    """The bucket of a feature's text: 28 bits of its MD5, which other engines have too."""
    return f"cast(pmod(cast(conv(left(md5({feature}), 7), 16, 10) as bigint), {buckets}) as int)"


@dataclass(frozen=True)
class LinearModel:
    """weights: (epoch, bucket, weight), bucket -1 being the intercept; history: a row per epoch; scale: (bucket, value)."""

    weights: DataFrame
    history: DataFrame
    best_epoch: int
    buckets: int
    scale: DataFrame | None = None
    mean: bool = False

    def table(self, epoch: int | None = None) -> DataFrame:
        """(bucket, weight) of one epoch, the best if none is named."""
        return self.weights.filter(F.col("epoch") == (epoch or self.best_epoch)).select("bucket", "weight")


def _dense(table: DataFrame | None, value: str, buckets: int, default: float) -> np.ndarray:
    """A table of at most buckets + 1 rows as an array; the intercept is last."""
    out = np.full(buckets + 1, default)
    if table is not None:
        for row in table.select("bucket", value).collect():
            out[row["bucket"]] = row[value]
    return out


def _sums(places: pa.ListArray, weights: np.ndarray, mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(logit of each example, buckets, example of each bucket, its factor) of a batch's list of bucket lists."""
    lengths = np.diff(places.offsets.to_numpy())
    buckets = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(places)), lengths)
    factor = 1.0 / np.maximum(lengths, 1)[owner] if mean else np.ones(len(buckets))
    return np.bincount(owner, weights[buckets] * factor, len(places)) + weights[-1], buckets, owner, factor


def _inner(column: pa.ListArray) -> pa.ListArray:
    """The bucket lists of a column of lists of lists, without what a slice hides."""
    flat = column.flatten()
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(flat.value_lengths())]), flat.flatten())


def step_sums(examples: DataFrame, weights: np.ndarray, scale: np.ndarray, weight: float, mean: bool) -> DataFrame:
    """(bucket, value): the loss's gradient, the weighted loss and the weights' total of the examples (labels, places).

    Each task sums its own examples and emits the buckets that it has seen; equal buckets are then added up.
    """
    effective = weights * scale

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, loss, mass, seen = np.zeros(len(weights)), 0.0, 0.0, False
        for batch in batches:
            labels = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            if not len(labels):
                continue
            z, buckets, owner, factor = _sums(_inner(batch.column(1)), effective, mean)
            own = np.where(labels == 1, weight, 1.0)
            error = own * (1 / (1 + np.exp(-z)) - labels)
            gradient[:-1] += np.bincount(buckets, error[owner] * factor, len(weights) - 1)
            gradient[-1] += error.sum()
            loss += (own * (np.maximum(z, 0) - z * labels + np.log1p(np.exp(-np.abs(z))))).sum()
            mass += own.sum()
            seen = True
        if seen:
            gradient *= scale
            at = np.flatnonzero(gradient)
            bucket = np.concatenate([np.where(at == len(weights) - 1, INTERCEPT, at), [LOSS, MASS]]).astype(np.int32)
            yield pa.record_batch([pa.array(bucket), pa.array(np.concatenate([gradient[at], [loss, mass]]))], names=["bucket", "value"])

    parts = examples.select("labels", "places").mapInArrow(partial, "bucket int, value double")
    return parts.groupBy("bucket").agg(F.sum("value").alias("value"))


class AdamW:
    """Adam with decoupled weight decay; a gradient longer than `clip` is shortened to it first."""

    def __init__(self, size: int, rate: float, clip: float, decay: float = 0.01):
        self.rate, self.clip, self.decay, self.step = rate, clip, decay, 0
        self.weights, self.first, self.second = np.zeros(size), np.zeros(size), np.zeros(size)

    def update(self, gradient: np.ndarray) -> None:
        self.step += 1
        gradient = gradient * min(1.0, self.clip / (np.sqrt((gradient**2).sum()) + 1e-6))
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        change = self.first / (1 - 0.9**self.step) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)
        self.weights = self.weights * (1 - self.rate * self.decay) - self.rate * change


def batch_of(key: str, batches: int, seed: int) -> str:
    """The batch of a row, by its key."""
    return bucket_sql(f"concat('{seed}::', cast({key} as string))", batches)


def train(examples: DataFrame, validation: DataFrame, buckets: int, epochs: int = 3, batches: int = 2, weight: float = 1.0, rate: float = 0.05,
          clip: float = 1.0, scale: DataFrame | None = None, mean: bool = False, threshold: float = 0.5, seed: int = 42) -> LinearModel:
    """Train on examples (id, labels, places) and keep the epoch with the best F1 on validation rows, the first of equals.

    A row holds any number of examples: `labels`, one 0 or 1 each, and `places`, its buckets (a bucket listed
    twice counts twice; with `mean`, places are averaged). scale (bucket, value) multiplies buckets. Positive
    examples weigh `weight`. Each epoch takes the rows in `batches` parts by a hash of the id, one step of AdamW per
    part, starting one part later than the epoch before. Rows are written once, partitioned by part, so a step
    reads its part only; what comes to the driver is a step's sums, at most buckets + 3 rows. Runs jobs.
    """
    spark = examples.sparkSession
    rows = written(examples.select(F.expr(batch_of("id", batches, seed)).alias("batch"), "labels", "places"), "batch")
    held = cut_lineage(validation.select("labels", "places"))
    factors = np.append(_dense(scale, "value", buckets, 0.0)[:-1] if scale is not None else np.ones(buckets), 1.0)
    optimizer, tables, history = AdamW(buckets + 1, rate, clip), [], []
    for epoch in range(1, epochs + 1):
        losses = []
        for k in range(batches):
            part = rows.filter(F.col("batch") == (epoch - 1 + k) % batches)
            sums = {r["bucket"]: r["value"] for r in step_sums(part, optimizer.weights, factors, weight, mean).collect()}
            mass, loss = sums.pop(MASS, 0.0), sums.pop(LOSS, 0.0)
            if not mass:
                continue
            gradient = np.zeros(buckets + 1)
            gradient[np.array([b for b in sums], np.int64)] = np.array(list(sums.values())) / mass
            optimizer.update(gradient)
            losses.append(loss / mass)
        tables.append(optimizer.weights)
        counts = _confusion(held, optimizer.weights * factors, mean, threshold)
        history.append((epoch, float(np.mean(losses)) if losses else None, *counts))
    listed = spark.createDataFrame(history, "epoch int, loss double, tp long, fp long, fn long, tn long")
    scored = with_scores(listed).withColumn("accuracy", F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("tokens")), F.lit(0.0)))
    best = scored.orderBy(F.desc("f1"), "epoch").first()["epoch"]
    return LinearModel(_weight_table(spark, tables), scored, best, buckets, scale, mean)


def _weight_table(spark: SparkSession, tables: Sequence[np.ndarray]) -> DataFrame:
    parts = []
    for epoch, weights in enumerate(tables, 1):
        at = np.flatnonzero(weights)
        bucket = np.where(at == len(weights) - 1, INTERCEPT, at)
        parts.append(pa.table({"epoch": pa.array(np.full(len(at), epoch, np.int32)), "bucket": pa.array(bucket.astype(np.int32)), "weight": pa.array(weights[at])}))
    return cut_lineage(spark.createDataFrame(pa.concat_tables(parts)))


def _confusion(rows: DataFrame, effective: np.ndarray, mean: bool, threshold: float) -> tuple[int, int, int, int]:
    """(tp, fp, fn, tn) of examples whose probability reaches the threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(4, np.int64)
        for batch in batches:
            labels = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(labels):
                z = _sums(_inner(batch.column(1)), effective, mean)[0]
                hit = 1 / (1 + np.exp(-z)) >= threshold
                cells += np.bincount(np.where(hit, np.where(labels == 1, 0, 1), np.where(labels == 1, 2, 3)), minlength=4)
        yield pa.record_batch([pa.array(cells[i:i + 1]) for i in range(4)], names=["tp", "fp", "fn", "tn"])

    sums = rows.mapInArrow(count, "tp long, fp long, fn long, tn long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "fp", "fn", "tn")])
    return tuple(sums.first())


def score(model: LinearModel, rows: DataFrame, keep: Sequence[str], epoch: int | None = None, in_task: int = IN_TASK) -> DataFrame:
    """keep and `scores`, the probability of each example of `places`, inside the row.

    The weight table is counted first. Up to in_task rows it goes to the tasks and the rows stay where they are; beyond,
    buckets are exploded and joined to it.
    """
    table = model.table(epoch)
    if model.scale is not None:
        factors = model.scale.select("bucket", "value").unionByName(model.scale.sparkSession.range(1).select(F.lit(INTERCEPT).alias("bucket"), F.lit(1.0).alias("value")))
        table = table.join(factors, "bucket").select("bucket", (F.col("weight") * F.col("value")).alias("weight"))
    if table.count() > in_task:
        return _score_by_join(table, rows, keep, model.mean)
    effective, mean, at = _dense(table, "weight", model.buckets, 0.0), model.mean, len(keep)

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            z = _sums(_inner(column), effective, mean)[0]
            sizes = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            scores = pa.ListArray.from_arrays(offsets, pa.array(1 / (1 + np.exp(-z))))
            yield pa.record_batch([*[batch.column(i) for i in range(at)], scores], names=[*keep, "scores"])

    schema = rows.select(*keep).schema.add("scores", ArrayType(DoubleType()))
    return rows.select(*keep, "places").mapInArrow(probabilities, schema)


def _score_by_join(table: DataFrame, rows: DataFrame, keep: Sequence[str], mean: bool) -> DataFrame:
    numbered = cut_lineage(rows.select(*keep, "places", F.monotonically_increasing_id().alias("__row")))
    each = numbered.select("__row", F.posexplode("places").alias("__pos", "__list"))
    weighed = each.select("__row", "__pos", F.size("__list").alias("__n"), F.explode("__list").alias("bucket")).join(table, "bucket").groupBy(
        "__row", "__pos").agg((F.sum("weight") / (F.first("__n") if mean else F.lit(1))).alias("z"))
    intercept = table.filter(F.col("bucket") == INTERCEPT).agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    z = F.coalesce(F.col("z"), F.lit(0.0)) + intercept
    listed = each.join(weighed, ["__row", "__pos"], "left").groupBy("__row").agg(F.collect_list(F.struct("__pos", (1 / (1 + F.exp(-z))).alias("p"))).alias("__s"))
    scores = F.coalesce(F.transform(F.array_sort("__s"), lambda s: s["p"]), F.array().cast("array<double>"))
    return numbered.join(listed, "__row", "left").select(*keep, scores.alias("scores"))


def inverse_document_frequencies(rows: DataFrame) -> DataFrame:
    """(bucket, value) of rows (places): ln((rows + 1) / (rows with the bucket + 1))."""
    listed = rows.select(F.array_distinct(F.flatten("places")).alias("buckets"))
    total = listed.count()
    counts = listed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bucket", F.log((F.lit(total) + 1) / (F.col("n") + 1)).alias("value"))
