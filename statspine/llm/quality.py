"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

A text becomes a vector of statistics of its bytes, words and lines, each on a scale on which good texts lie close
together. For both classes the mean and the covariance are estimated from sums that Spark adds up; a covariance is shrunk
towards its own diagonal and towards the pooled one. A text's score compares the two log densities: half the difference
of its squared Mahalanobis distances, solved with the Cholesky factor of each class that is computed once, and of the log
determinants; a logistic function fitted to training rows makes it a probability.

Defined results: null texts are empty; an empty text has a vector like any other; repeated rows give repeated results; an
empty table gives an empty table; with fewer than two labelled rows of a class every score is that class's share (0.5
without any); labels that are null are left out; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspine.llm.common import logistic, training_rows, written

#: labelled rows that the model is fitted on, at most
SAMPLE = 20_000
#: shrinkage of a class covariance towards the pooled one, then towards its diagonal
POOLED, DIAGONAL = 0.1, 0.1
THRESHOLD = 0.7

UPPER, LOWER, DIGIT = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(97, 123), range(48, 58)))
SENTENCE = np.isin(np.arange(256), list(b".,"))
SPACE = np.isin(np.arange(256), list(b" \t\r\n\x0b\x0c"))
SYMBOL = ~(UPPER | LOWER | DIGIT | SENTENCE | SPACE) & (np.arange(256) < 128)
NAMES = (
    "size", "upper", "digit", "symbol", "sentence", "space", "word_length", "distinct_words", "top_word", "distinct_lines",
    "line_length", "symbol_kinds", "capital_words", "repeats",
)


def _logit(share: float, n: float) -> float:
    """Log odds of a share of n things, with half a thing added on either side."""
    return float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``NAMES``."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = max(1, len(data))
    upper, digit, symbol, sentence, space = (int(seen[c].sum()) for c in (UPPER, DIGIT, SYMBOL, SENTENCE, SPACE))
    letters = max(1, n - digit - symbol - sentence - space)
    words, lines = text.split(), text.split("\n")
    counts = Counter(words)
    w = max(1, len(words))
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(len(data))), _logit(upper / letters, letters), _logit(digit / n, n), _logit(symbol / n, n),
        _logit(sentence / n, n), _logit(space / n, n), float(np.log((n - space + 1) / w)), float(np.log(len(counts) + 1) - np.log(w + 1)),
        _logit(max(counts.values(), default=0) / w, w), float(np.log(len(set(lines)) / len(lines))), float(np.log1p(n / len(lines))),
        float(np.log1p(np.count_nonzero(seen[SYMBOL]))), _logit(sum(map(str.isupper, counts)) / max(1, len(counts)), max(1, len(counts))),
        float(np.log(pairs + 1) - np.log(w)),
    ]


@dataclass
class Discriminant:
    """Means and cached Cholesky factors of the classes 0 and 1, and the logistic scale of their density difference."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    bias: float = 0.0
    slope: float = 1.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0 for rows of statistics."""
        densities = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets):
            z = np.linalg.solve(factor, (x - mean).T)
            densities.append(-0.5 * ((z * z).sum(axis=0) + logdet))
        return densities[1] - densities[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * squash(self.difference(x)), -30, 30)))


def squash(d: np.ndarray) -> np.ndarray:
    """Density differences on a scale between logarithmic and linear: outliers do not steer the logistic fit."""
    return np.arcsinh(d)


def fitted(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """From the number, sums and sums of products of the rows of each class."""
    means = [sums[k] / n[k] for k in (0, 1)]
    own = [squares[k] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    together = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    factors, logdets = [], []
    for k in (0, 1):
        s = (1 - pooled) * own[k] + pooled * together
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-6 * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        factors.append(factor)
        logdets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(means, factors, logdets)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each class: n, sums and sums of products, as one list."""
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, d)
        y = batch.column("label").to_numpy()
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["label", "m"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant | float:
    """A discriminant from at most ``sample`` labelled training rows, or the share of good ones where that can't be fitted."""
    rows = written(training_rows(docs, labels, "quality", sample), "quality-training")
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInArrow(_moments, "label int, m array<double>").collect():  # two rows for each task
        total[r["label"]] += r["m"]
    n = total[:, 0]
    if n.min() < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    model = fitted(n, total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(model.difference(x)), batch.column("label")], names=["x", "label"])

    seen = rows.mapInArrow(differences, "x double, label int").collect()
    model.bias, model.slope = logistic(squash(np.array([r["x"] for r in seen])), np.array([r["label"] for r in seen], dtype=float))
    return model


def scored(docs: DataFrame, model: Discriminant | float) -> DataFrame:
    """(doc_id, score, statistics) of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(NAMES))
            scores = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            arrays = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(x.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "statistics"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, score double, statistics array<double>")
