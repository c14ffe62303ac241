"""The weight-table model against the same steps written out with arrays, and its two ways to score."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import linear, student

SIZE = 16


def bucket(text, buckets=SIZE):
    return int(hashlib.md5(text.encode()).hexdigest()[:7], 16) % buckets


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = []
    for i in range(80):
        places = [rng.integers(0, SIZE, rng.integers(0, 6)).tolist() for _ in range(rng.integers(0, 5))]
        made.append((f"r{i}", [int(sum(p) % 3 == 0) for p in places], places))
    return spark.createDataFrame(made, "id string, labels array<int>, places array<array<int>>"), made


def by_hand(rows, epochs, batches, weight, rate, scale, mean, seed=42):
    """[(weights, loss)] after each epoch, the intercept last."""
    parts = [[r for r in rows if bucket(f"{seed}::{r[0]}", batches) == b] for b in range(batches)]
    w, m, v, step, out = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1), 0, []

    def vector(places):
        x = np.zeros(SIZE + 1)
        for p in places:
            x[p] += scale[p] / (len(places) if mean else 1)
        x[-1] = 1
        return x

    for epoch in range(epochs):
        losses = []
        for k in range(batches):
            step += 1
            g, loss, mass = np.zeros(SIZE + 1), 0.0, 0.0
            for _, labels, lists in parts[(epoch + k) % batches]:
                for y, places in zip(labels, lists, strict=True):
                    x, own = vector(places), weight if y else 1.0
                    p = 1 / (1 + np.exp(-x @ w))
                    g += own * (p - y) * x
                    loss -= own * np.log(p if y else 1 - p)
                    mass += own
            g, loss = g / mass, loss / mass
            g *= min(1.0, 1.0 / (np.linalg.norm(g) + 1e-6))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - rate * 0.01) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            losses.append(loss)
        out.append((w, np.mean(losses)))
    return out, vector


@pytest.mark.parametrize(("mean", "scaled"), [(False, False), (True, True)])
def test_epochs_equal_the_steps_written_out(spark, rows, mean, scaled):
    table, made = rows
    scale = np.linspace(0.5, 2, SIZE) if scaled else np.ones(SIZE)
    factors = spark.createDataFrame([(i, float(x)) for i, x in enumerate(scale)], "bucket int, value double") if scaled else None
    model = linear.train(table.repartition(5), table, SIZE, 4, 3, 2.5, 0.3, scale=factors, mean=mean)
    want, vector = by_hand(made, 4, 3, 2.5, 0.3, scale, mean)
    history = {r["epoch"]: r for r in model.history.collect()}
    f1 = []
    for epoch, (weights, loss) in enumerate(want, 1):
        got = np.zeros(SIZE + 1)
        for r in model.table(epoch).collect():
            got[r["bucket"]] = r["weight"]
        assert np.allclose(got, weights, atol=1e-9) and history[epoch]["loss"] == pytest.approx(loss)
        cells = [(y, int(vector(p) @ weights >= 0)) for _, labels, lists in made for y, p in zip(labels, lists, strict=True)]
        assert [history[epoch][c] for c in ("tp", "fp", "fn", "tn")] == [cells.count(x) for x in ((1, 1), (0, 1), (1, 0), (0, 0))]
        f1.append(history[epoch]["f1"])
    assert model.best_epoch == 1 + int(np.argmax(f1))
    inside = {r["id"]: r["scores"] for r in linear.score(model, table, ["id"]).collect()}
    joined = {r["id"]: r["scores"] for r in linear.score(model, table, ["id"], in_task=1).collect()}
    best = want[model.best_epoch - 1][0]
    for i, _, lists in made:
        right = [1 / (1 + np.exp(-vector(p) @ best)) for p in lists]
        assert np.allclose(inside[i], right) and np.allclose(joined[i], right), i


def test_no_rows_and_no_words(spark, rows):
    none = rows[0].limit(0)
    model = linear.train(none, none, SIZE, 2)
    assert [r["loss"] for r in model.history.collect()] == [None, None] and model.best_epoch == 1 and model.table().collect() == []
    assert linear.score(model, rows[0].limit(1), ["id"]).first()["scores"] == [0.5] * len(rows[1][0][2])
    empty = spark.createDataFrame([("a", []), ("b", ["x"])], "id string, words array<string>").withColumn("labels", F.transform("words", lambda w: F.lit(1)))
    fitted = student.fit_student(empty, iterations=1)
    assert {r["id"]: len(r["scores"]) for r in student.score_rows(fitted, empty).collect()} == {"a": 0, "b": 1}
    assert [(r["id"], r["pos"], r["gold"]) for r in student.score_words(fitted, empty, "labels").collect()] == [("b", 0, 1)]


def test_attacker_learns_a_word(spark):
    texts = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") + f"word{i % 7} and more", str(i % 2)) for i in range(200)], "id int, text string, task_label string")
    model = student.fit_attacker(texts.filter("id < 150"), texts.filter("id >= 150"), iterations=4)
    held = texts.filter("id >= 150").selectExpr("id", "text", "task_label", "'original' as condition", "0 as trial")
    assert all(r["predicted"] == r["gold"] and r["p_gold"] > 0.5 for r in student.attack(model, held).collect())
