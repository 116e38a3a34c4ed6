"""Quadratic discriminant: density difference, shrinkage, held-out accuracy."""

import random

import numpy as np
import pytest

from statspine.llm import quality as Q
from statspine.llm.common import held_out


def test_difference_is_that_of_the_log_densities():
    rng = np.random.default_rng(0)
    d = 4
    x = [rng.normal(size=(200, d)) @ rng.normal(size=(d, d)) + k for k in (0, 1)]
    model = Q.fitted(np.array([200.0, 200.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), pooled=0, diagonal=0)
    points = rng.normal(size=(10, d))
    dense = []
    for a in x:
        s = np.cov(a.T, bias=True) + 1e-6 * np.eye(d)
        m = points - a.mean(0)
        dense.append(-0.5 * (np.einsum("ij,jk,ik->i", m, np.linalg.inv(s), m) + np.linalg.slogdet(s)[1]))
    assert model.difference(points) == pytest.approx(dense[1] - dense[0])


def test_shrinkage_keeps_degenerate_classes_regular():
    n, sums = np.array([5.0, 5.0]), np.ones((2, 3))
    model = Q.fitted(n, sums, np.zeros((2, 3, 3)) + 0.2)
    assert np.isfinite(model.difference(np.zeros((1, 3)))).all()


@pytest.mark.parametrize("text", [None, "", "\n\n", "a", "Ä" * 1000, "word " * 50_000, "!!!", "1 2 3"])
def test_statistics_are_finite(text):
    x = Q.statistics(text)
    assert len(x) == len(Q.NAMES) and np.isfinite(x).all()
    if text is None:
        assert x == Q.statistics("")


def corpus(spark, n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 200))]
        good = i % 5 != 0
        text = ". ".join(" ".join(words[a : a + 9]).capitalize() for a in range(0, len(words), 9)) if good else " ".join(w.upper() + "!!" for w in words[:9] * 8)
        docs.append((i, text, "x"))
        labels.append((i, int(good), None))
    docs += [(n, None, "x"), (n + 1, "", "x"), (0, docs[0][1], "x"), (None, "no id", "x")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, statistics string"),
        spark.createDataFrame([*labels, (n, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = Q.scored(docs, Q.learn(docs, labels)).withColumn("held", held_out()).collect()
    assert len(out) == 404 and all(0 <= r.score <= 1 for r in out)
    tested = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([(r.score >= Q.THRESHOLD) == (r.doc_id % 5 != 0) for r in tested]) > 0.97
    by = {r.doc_id: r.score for r in out}
    assert by[400] == by[401]


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(spark, 100)
    changed = labels.withColumn("quality", (labels.quality * (1 - held_out().cast("int"))).cast("int"))
    one, other = Q.learn(docs, labels), Q.learn(docs, changed)
    assert all((a == b).all() for a, b in zip(one.means, other.means)) and (one.bias, one.slope) == (other.bias, other.slope)


def test_too_few_labels_and_empty(spark):
    docs, labels = corpus(spark, 20)
    assert Q.learn(docs, labels.limit(0)) == 0.5
    only = Q.learn(docs, labels.where("quality = 1"))
    assert only == 1.0 and {r.score for r in Q.scored(docs, only).collect()} == {1.0}
    assert Q.scored(docs.limit(0), only).count() == 0
