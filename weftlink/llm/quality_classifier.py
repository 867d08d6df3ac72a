"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One set of weights over hashed text features is shared by all grades; ordered thresholds cut the line:
P(grade > j) = logistic(w.x - t_j), t_0 < t_1 < ... Features: the mean over a text's character n-grams (1 to 3 code
points, A-Z read as a-z) of a hashed weight, and hashed tokens for tenths of the shares of repeated words and lines.
From one fit come the expected grade and the tail probability that selects documents.

The model is fitted on the driver from at most ``FIT_ROWS`` rated documents (those with the least hashed ids).

Cases: null and blank texts have no n-grams and are judged by the thresholds alone; with fewer than two grades every
document gets the only grade (0 without ratings); of several ratings of a document the least counts; repeated rows are
scored one by one; an empty table gives an empty result; columns that the operator doesn't use are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .features import chunks, code_points, labelled_sample, ngrams, trimmed
from .kernels import mix, word_hashes

SIZES, BITS, TOKENS = (1, 2, 3), 12, 64
FIT_ROWS, STEPS, RIDGE = 4000, 300, 1e-3
#: Documents are selected whose grade is at least GRADE with a probability of at least TAIL.
GRADE, TAIL = 1, 0.25
_WIDTH = (1 << BITS) + TOKENS


def _tokens(text: str) -> list[int]:
    """Hashed tokens of a text's repetition: tenths of words that repeat the one before, of repeated words and lines."""
    words = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = (
        float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0,
        1 - len(np.unique(words)) / len(words) if len(words) else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
    )
    kinds = np.array([(i << 8) | int(s * 10) for i, s in enumerate(shares)], dtype=np.uint64)
    return [(1 << BITS) + int(x) for x in mix(kinds + np.uint64(99)) % np.uint64(TOKENS)]


def _dense(texts: list[str]) -> np.ndarray:
    """Feature rows (float32), a text each."""
    out = np.zeros((len(texts), _WIDTH), dtype=np.float32)
    codes, offsets = code_points(texts)
    for n in SIZES:
        bucket, owner = ngrams(codes, offsets, n, BITS)
        counts = np.bincount(owner * (1 << BITS) + bucket, minlength=len(texts) << BITS).reshape(len(texts), 1 << BITS)
        out[:, : 1 << BITS] += counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for i, text in enumerate(texts):
        out[i, _tokens(text)] = 1
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  #: float64, one for each hashed feature
    thresholds: np.ndarray  #: ascending, one fewer than grades
    grades: np.ndarray  #: ascending

    def lines(self, texts: list[str]) -> np.ndarray:
        """w.x of each text."""
        codes, offsets = code_points(texts)
        total = np.zeros(len(texts))
        for n in SIZES:
            bucket, owner = ngrams(codes, offsets, n, BITS)
            count = np.bincount(owner, minlength=len(texts))
            total += np.bincount(owner, weights=self.weights[bucket], minlength=len(texts)) / np.maximum(count, 1)
        return total + np.array([self.weights[np.unique(_tokens(t))].sum() for t in texts])

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade >= GRADE))."""
        above = _logistic(self.lines(texts)[:, None] - self.thresholds[None, :])
        steps = np.diff(self.grades)
        expected = self.grades[0] + (above * steps).sum(axis=1)
        at = np.searchsorted(self.grades, GRADE)
        tail = np.ones(len(texts)) if at == 0 else np.zeros(len(texts)) if at == len(self.grades) else above[:, at - 1]
        return expected, tail


def _thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and logarithms of the gaps."""
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, raw: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log likelihood with the ridge, by the weights and by ``raw``; ``y`` numbers the grades."""
    t, rows = _thresholds(raw), np.arange(len(y))
    below = _logistic(t[None, :] - (x @ w.astype(np.float32))[:, None])
    edge = np.zeros((len(y), 1))
    cdf, dens = np.concatenate([edge, below, edge + 1], axis=1), np.concatenate([edge, below * (1 - below), edge], axis=1)
    p = np.maximum(cdf[rows, y + 1] - cdf[rows, y], 1e-9)
    up, low = dens[rows, y + 1] / p, dens[rows, y] / p
    gw = x.T @ ((up - low) / len(y)).astype(np.float32) + RIDGE * w
    gt = np.array([(-(up * (y == j)) + low * (y == j + 1)).mean() for j in range(grades - 1)])
    return gw, np.concatenate([[gt.sum()], [gt[j:].sum() * np.exp(raw[j]) for j in range(1, grades - 1)]])


def fit(texts: list[str], ratings: np.ndarray) -> Model:
    grades, y = np.unique(ratings, return_inverse=True) if len(ratings) else (np.array([0]), np.zeros(0, np.int64))
    grades = grades.astype(np.float64)
    if len(grades) < 2:
        return Model(np.zeros(_WIDTH), np.zeros(0), grades)
    x = np.concatenate([_dense(part) for part in _batches(texts, 256)])
    spread = x.std(axis=0)
    scale = np.where(spread > 0, 1 / np.maximum(spread, 1e-4), 0).astype(np.float32)
    mean = x.mean(axis=0)
    x = (x - mean) * scale
    share = np.cumsum(np.bincount(y, minlength=len(grades)))[:-1] / len(y)
    t0 = np.log(share / (1 - share))
    params = [np.zeros(x.shape[1]), np.concatenate([t0[:1], np.log(np.maximum(np.diff(t0), 1e-3))])]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        for i, g in enumerate(gradient(x, y, *params, len(grades))):
            m, v = moments[i]
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            params[i] = params[i] - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, raw = params
    return Model(w * scale, _thresholds(raw) + float((w * scale) @ mean), grades)


def _batches(texts: list[str], n: int) -> Iterator[list[str]]:
    for i in range(0, len(texts), n):
        yield texts[i : i + n]


def train(docs: DataFrame, ratings: DataFrame) -> Model:
    """``ratings``: (doc_id, grade)."""
    usable = ratings.where(F.col("grade").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = labelled_sample(docs, usable, "grade", FIT_ROWS)
    model = fit(sample["text"].to_pylist(), sample["grade"].to_numpy())
    del sample
    trimmed()
    return model


def graded(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """``(doc_id, expected_grade, tail_probability, kept)`` of each row."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, ratings))  # some 4,000 weights

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = [model.judge(part) for part in chunks(batch["text"])]
            expected, tail = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(2))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(expected), pa.array(tail)], names=["doc_id", "expected_grade", "tail_probability"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, expected_grade double, tail_probability double")
    return out.withColumn("kept", F.col("tail_probability") >= TAIL)


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grades made from the labels: 0 poor, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return graded(docs, labels.select("doc_id", grade.alias("grade")))
