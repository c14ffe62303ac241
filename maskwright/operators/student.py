"""A linear student (word scorer) and a linear attacker (sentence classifier) over hashed features."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from maskwright.functions import marks
from maskwright.functions.text import redact, words
from maskwright.operators import linear
from maskwright.operators.leakage import with_original_answer
from maskwright.operators.linear import LinearModel
from maskwright.operators.metrics import class_weight
from maskwright.session import cut_lineage

BUCKETS = 1 << 16


PAD = "<pad>"
#: A word's shape: X, x and 9 for runs of capitals, other letters and digits.
_SHAPE = ((r"\p{Lu}+", "X"), (r"[\p{L}&&[^\p{Lu}]]+", "x"), (r"\p{Nd}+", "9"))


def _shape(word: Column) -> Column:
    for pattern, sign in _SHAPE:
        word = F.regexp_replace(word, pattern, sign)
    return word


def _place_lists(low: pa.Array, shapes: pa.Array, buckets: int) -> pa.Array:
    """The distinct buckets of the eight features of every word: word, shape, affixes, two words on each side."""
    lengths = low.value_lengths().fill_null(0).to_numpy()
    words, forms = low.flatten().dictionary_encode(), shapes.flatten().dictionary_encode()
    known, kinds = words.dictionary.to_pylist(), forms.dictionary.to_pylist()

    def hashed(name: str, values: list[str]) -> np.ndarray:  # as linear.bucket_sql; few words differ, so each is hashed once
        return np.array([int(md5((name + v).encode()).hexdigest()[:7], 16) % buckets for v in values], np.int32)

    at, end = words.indices.to_numpy(), np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(at))
    start = end - np.repeat(lengths, lengths)

    def neighbour(step: int) -> np.ndarray:
        table = hashed(f"{step:+d}=", [*known, PAD])
        there = place + step
        inside = (there >= start) & (there < end)
        return table[np.where(inside, at[np.where(inside, there, 0)], len(known))] if len(at) else np.zeros(0, np.int32)

    columns = np.stack([
        hashed("w=", known)[at], hashed("s=", kinds)[forms.indices.to_numpy()], hashed("p=", [v[:3] for v in known])[at],
        hashed("e=", [v[-3:] for v in known])[at], *[neighbour(step) for step in (-1, -2, 1, 2)]], axis=1)
    fresh = np.ones(columns.shape, bool)
    for j in range(1, columns.shape[1]):
        fresh[:, j] = (columns[:, :j] != columns[:, j:j + 1]).all(axis=1)
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(fresh.sum(axis=1))]).astype(np.int32)), pa.array(columns[fresh]))
    return marks.lists(np.concatenate([[0], np.cumsum(lengths)]), inner, low)


def _places(buckets: int) -> Column:
    """The distinct buckets of the features of every word of ``words``.

    Words are lowered and shaped by Spark; a task hashes each different word of a batch once.
    """
    @F.arrow_udf(ArrayType(ArrayType(IntegerType())))
    def places(low: pa.Array, shapes: pa.Array) -> pa.Array:
        return marks.in_parts(lambda *columns: _place_lists(*columns, buckets), low, shapes)

    return places(F.transform("words", F.lower), F.transform("words", _shape))


def student_examples(rows: DataFrame, buckets: int = BUCKETS, labels: str = "labels", id_col: str = "id") -> DataFrame:
    """(id, labels, places) of rows with words: features are word, shape (X, x, 9), affixes and two words on each side.

    The neighbours come from the word array of the same row, so no window is needed.
    """
    return rows.select(F.col(id_col).alias("id"), F.col(labels).alias("labels"), _places(buckets).alias("places"))


def fit_student(train: DataFrame, validation: DataFrame | None = None, weight: float | None = None, buckets: int = BUCKETS,
                iterations: int = 3, batches: int = 2, rate: float = 0.05) -> LinearModel:
    """The epoch with the best F1 on validation rows (default: the training rows) of `iterations` epochs.

    Words are weighted by class (`class_weight`) unless a weight is given. Runs training jobs.
    """
    if weight is None:
        weight = float(class_weight(train).first()["class_weight"] or 1.0)
    examples = student_examples(train, buckets)
    return linear.train(examples, examples if validation is None else student_examples(validation, buckets), buckets, iterations, batches, weight, rate)


def score_rows(model: LinearModel, rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(id, carried columns, words, scores): the probability of every word, inside the row: words are never exploded or shuffled."""
    placed = rows.select("id", *carry, "words", _places(model.buckets).alias("places"))
    return linear.score(model, placed, ["id", *carry, "words"])


def score_words(model: LinearModel, rows: DataFrame, labels: str | None = None, max_length: int | None = None,
                carry: tuple[str, ...] = (), name: str = "linear") -> DataFrame:
    """(id, pos, word, gold, score); words at or after ``max_length`` get a null score."""
    gold = [labels] if labels else []
    scored = score_rows(model, rows, (*carry, *gold))
    zipped = scored.select("id", *carry, *gold, F.posexplode(F.arrays_zip("words", "scores")).alias("pos", "t"))
    score = F.col("t.scores") if max_length is None else F.when(F.col("pos") < max_length, F.col("t.scores"))
    return zipped.select("id", *carry, "pos", F.col("t.words").alias("word"), *[F.get(F.col(g), F.col("pos")).cast("int").alias("gold") for g in gold],
                         score.alias("score"), F.lit(name).alias("model"))


def predict_text(model: LinearModel, texts: DataFrame, threshold: float) -> DataFrame:
    """Words, probabilities and the redacted string of unlabelled texts (id, text); texts without words come back too."""
    rows = texts.select("id", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("words"))
    scored = score_rows(model, rows).withColumn("pred", F.transform("scores", lambda x: (x >= threshold).cast("int")))
    return scored.withColumn("redacted", redact(F.col("words"), F.col("pred")))


def teacher_indices(teacher: DataFrame, pattern: str, id_col: str = "id") -> DataFrame:
    """Row numbers hidden in teacher ids such as ``corpus-train-17``."""
    found = F.regexp_extract(id_col, pattern, 1)
    return teacher.select(F.when(found != "", found).cast("bigint").alias("source_index")).filter("source_index is not null")


def attacker_rows(corpus: DataFrame, teacher: DataFrame, index: str = "source_index") -> DataFrame:
    """Corpus rows the teacher has not seen."""
    return corpus.join(teacher.select(F.col("source_index").alias(index)).distinct(), index, "left_anti")


def attacker_examples(texts: DataFrame, buckets: int = BUCKETS, label: str = "task_label", carry: Sequence[str] = ()) -> DataFrame:
    """(carried columns, labels, places) of texts: one example of all lower-case words' buckets, 1 where the label is not 0."""
    terms = F.transform(F.coalesce(words(F.col("text")), F.array().cast("array<string>")), F.lower)
    placed = texts.select(*carry, F.array((F.col(label).cast("int") != 0).cast("int")).alias("labels"), terms.alias("_terms"))
    return placed.select(*carry, "labels", F.array(F.expr(f"transform(_terms, t -> {linear.bucket_sql('t', buckets)})")).alias("places"))


def fit_attacker(rows: DataFrame, validation: DataFrame | None = None, label: str = "task_label", buckets: int = BUCKETS,
                 iterations: int = 3, batches: int = 2, rate: float = 1.0) -> LinearModel:
    """Logistic regression on the mean of a text's words, weighted by inverse document frequency. Runs training jobs."""
    examples = attacker_examples(rows, buckets, label, ["id"])
    held = examples if validation is None else attacker_examples(validation, buckets, label, ["id"])
    scale = cut_lineage(linear.inverse_document_frequencies(examples))
    return linear.train(examples, held, buckets, iterations, batches, 1.0, rate, scale=scale, mean=True)


def attack(model: LinearModel, texts: DataFrame, label: str = "task_label") -> DataFrame:
    """Attacker answers for every condition: gold, predicted, p_gold and its answer on the original."""
    keys = [c for c in ("id", "condition", "trial") if c in texts.columns]
    scored = linear.score(model, attacker_examples(texts, model.buckets, label, keys), [*keys, "labels"])
    gold, p = F.col("labels")[0], F.col("scores")[0]
    answers = scored.select(*keys, gold.alias("gold"), (p >= 0.5).cast("int").alias("predicted"), F.when(gold == 1, p).otherwise(1 - p).alias("p_gold"))
    return with_original_answer(answers)
