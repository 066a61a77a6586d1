"""Cumulative-link (ordinal logistic) regression with shared weights and ordered thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm import text_features as X
from spanledger.llm import textscan as T
from spanledger.operators.support import Shelf

STEPS, RATE, RIDGE = 300, 0.1, 1e-3
PASSES, CLOSE = 60, 1e-4  # of the fit by tasks: steps at most, and the slope that ends it
PAIRS = 1 << 19  # (row, feature) pairs that a step of the fit takes at once


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def summed(to: np.ndarray, of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """For each number below ``size`` the sum of values[of] over the pairs (to, of) with it, a bounded part at a time."""
    total = np.zeros(size)
    for i in range(0, len(to), PAIRS):
        total += np.bincount(to[i:i + PAIRS], values[of[i:i + PAIRS]], minlength=size)
    return total


def _limits(theta: np.ndarray, features: int) -> np.ndarray:
    return np.concatenate(([theta[features]], theta[features] + np.cumsum(np.exp(theta[features + 1:]))))


def _start(sizes: np.ndarray, features: int) -> np.ndarray:
    """No weights, and the thresholds that give the grades' shares."""
    tail = np.array([np.clip(sizes[j + 1:].sum() / sizes.sum(), 1e-3, 1 - 1e-3) for j in range(len(sizes) - 1)])
    first = -np.log(tail / (1 - tail))
    return np.concatenate((np.zeros(features), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))))


def _slopes(theta: np.ndarray, grade: np.ndarray, row: np.ndarray, column: np.ndarray, features: int, grades: int) -> np.ndarray:
    """Sums over rows: the negative log likelihood, its slopes by the weights, and by the k thresholds."""
    n, k, t = len(grade), grades - 1, _limits(theta, features)
    s = summed(row, column, theta[:features], n)
    p = np.concatenate((np.ones((n, 1)), sigmoid(s[:, None] - t), np.zeros((n, 1))), 1)
    slope = p * (1 - p)
    own = np.arange(n)
    likely = np.maximum(p[own, grade] - p[own, grade + 1], 1e-9)
    ds = -(slope[own, grade] - slope[own, grade + 1]) / likely
    dt = [(slope[grade == j + 1, j + 1] / likely[grade == j + 1]).sum() - (slope[grade == j, j + 1] / likely[grade == j]).sum() for j in range(k)]
    return np.concatenate(([-np.log(likely).sum()], summed(column, row, ds, features), dt))


def _objective(theta: np.ndarray, sums: np.ndarray, n: int, features: int) -> tuple[float, np.ndarray]:
    """The ridge loss of a row and its gradient, from the sums over rows."""
    w, dt = theta[:features], sums[features + 1:] / n
    g = np.concatenate((sums[1:features + 1] / n + RIDGE * w, [dt.sum()],
                        [dt[j:].sum() * np.exp(theta[features + j]) for j in range(1, len(dt))]))
    return sums[0] / n + RIDGE / 2 * w @ w, g


def fit(grade: np.ndarray, row: np.ndarray, column: np.ndarray, features: int, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by gradient steps (Adam) on the log likelihood: P(grade >= k) = s(w x - t[k])."""
    n, k = len(grade), grades - 1
    if not n:
        return np.zeros(features), np.zeros(k)
    theta = _start(np.bincount(grade, minlength=grades), features)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, g = _objective(theta, _slopes(theta, grade, row, column, features, grades), n, features)
        m, v = .9 * m + .1 * g, .999 * v + .001 * g * g
        theta = theta - RATE * (m / (1 - .9 ** step)) / (np.sqrt(v / (1 - .999 ** step)) + 1e-8)
    return theta[:features], _limits(theta, features)


def _direction(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The L-BFGS step from the last changes of place and gradient."""
    q, back = g.copy(), []
    for s, y in reversed(past):
        back.append(s @ q / (s @ y))
        q -= back[-1] * y
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(back)):
        q += (a - y @ q / (s @ y)) * s
    return -q


def fit_all(told: DataFrame, sizes: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The same fit over all stored rows (grade, have) by L-BFGS; ``sizes`` counts the rows of each grade. Tasks sum the
    slopes of their rows; the driver holds a number for each weight and task."""
    theta, grades, n = _start(sizes, features), len(sizes), int(sizes.sum())

    def at(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + features + grades - 1)
            for b in batches:
                total += _slopes(theta, *X.pairs(b.column(0), b.column(1)), features, grades)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])
        parts = told.select("grade", "have").mapInArrow(run, "sums binary").collect()
        # Added in an order that does not depend on which task ends first.
        return _objective(theta, np.sum(sorted((np.frombuffer(r["sums"]) for r in parts), key=lambda x: tuple(x[:2])), axis=0), n, features)

    (loss, g), past = at(theta), []
    for _ in range(PASSES):
        if np.abs(g).max() < CLOSE:
            break
        way, step = _direction(g, past), 1.0 if past else min(1.0, 1 / np.linalg.norm(g))
        for _ in range(8):
            there = theta + step * way
            new, h = at(there)
            if new <= loss + 1e-4 * step * (g @ way):
                break
            step /= 2
        else:
            break
        if (there - theta) @ (h - g) > 1e-12:
            past = [*past, (there - theta, h - g)][-8:]
        theta, loss, g = there, new, h
    return theta[:features], _limits(theta, features)


def tails(text: pa.Array, extract: X.Extract, weights: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2 and so on of each text. ``weights`` has a value for each hash bucket."""
    data, at = T.utf8(text)
    owner, feature = extract(data, at)
    live = weights[feature] != 0
    owner, feature = X.distinct(owner[live], feature[live])
    return sigmoid(np.bincount(owner, weights[feature], minlength=len(at) - 1)[:, None] - thresholds)


def both(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and words share the buckets."""
    (a, x), (b, y) = X.shapes(data, at), X.words_and_stems(data, at)
    return np.concatenate((a, b)), np.concatenate((x, y))


def learned(stored: DataFrame, extract: X.Extract, grades: int, rows: int = X.TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all hash buckets and the thresholds, from all stored (text, grade) rows.

    Features are chosen and weights fitted over all rows; the driver fits up to ``rows`` by itself.
    """
    chosen, shelf = X.choose(stored, extract, grades), Shelf(stored.sparkSession)
    told = shelf.put(X.told_rows(stored, extract, chosen), "told")
    weights = np.zeros(X.BUCKETS)
    sizes = np.zeros(grades)
    for r in told.groupBy("grade").count().collect():
        sizes[r["grade"]] = r["count"]
    found, thresholds = fit(*X.matrix(told), len(chosen), grades) if sizes.sum() <= rows else fit_all(told, sizes, len(chosen))
    shelf.drop("told")
    weights[chosen] = found
    return weights, thresholds


def graded(docs: DataFrame, ratings: DataFrame, grades: int = 3, least: int = 1, rows: int = X.TRAINING_ROWS) -> DataFrame:
    """(doc_id, expected_grade, tail, kept) for each row of ``docs`` (doc_id, text).

    ``ratings`` is (doc_id, grade), grades 0 to grades - 1; all are fitted, up to ``rows`` by the driver. ``tail`` is
    P(grade >= least) and ``kept`` tells whether it reaches one half. Null and empty texts get the tail of
    a text without words; without ratings every tail is one half. The model has a weight for each hashed feature
    that tells grades apart (``text_features.choose``), however many; others weigh nothing. Whole texts are read in
    pieces, so long ones cost no more memory than their own length. Of a repeated id the greatest rating counts; repeated rows are judged each. An empty table gives no
    rows. Other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession)
    stored = shelf.put(X.training_rows(docs, ratings), "fit")
    weights, thresholds = learned(stored, both, grades, rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.pieces(batches, "text"):
            p = tails(b.column(1), both, weights, thresholds)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, least - 1]), pa.array(p[:, least - 1] >= .5)],
                                             ["doc_id", "expected_grade", "tail", "kept"])
    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, expected_grade double, tail double, kept boolean")
