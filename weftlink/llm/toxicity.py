"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams of 3 to 5 code points (A-Z read as a-z), present or not. Over the labelled sample
each feature's log-count ratio r = ln((p + 1) / (P + 2)) - ln((q + 1) / (Q + 2)) compares the toxic texts that have it
with the others; its value is r where present, and regularised logistic regression learns a weight for every feature
that differs between the classes by more than chance (a significance test, so their number follows the sample). A score
is the logistic of the sum over a text's distinct features.

The model is fitted on the driver from at most ``FIT_ROWS`` labelled documents (those with the least hashed ids).

Cases: null and blank texts have no features and get the score of the intercept; without labels of both classes the
score is the share of label 1 (one half without any label); a document with several labels is toxic if one says so;
a null doc_id has crc32 0 and so is held out; repeated rows are scored one by one; an empty table gives an empty
result; columns that the operator doesn't use are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .features import chunks, code_points, crc32_of, gram_buckets, labelled_sample, minimised, trimmed

SIZES, BITS = (3, 4, 5), 20
FIT_ROWS, STEPS, RIDGE = 6000, 60, 5e-4
#: A feature counts if its chi-square statistic says that chance explains it in one of 10,000 cases at most.
CHI_SQUARE = 15.14
#: Characters that fitting works on at a time, so that it stays small beside the driver's JVM.
FIT_CHUNK = 1 << 17


def present(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct buckets of each text."""
    codes, offsets = code_points(texts)
    hashed = [gram_buckets(codes, n, BITS) for n in SIZES]
    seat = np.zeros(1 << BITS, dtype=np.int32)
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        bucket = np.concatenate([h[lo : max(lo, hi - n + 1)] for h, n in zip(hashed, SIZES)])
        place = np.arange(len(bucket), dtype=np.int32)
        seat[bucket] = place  # one of the places of each bucket stays
        yield bucket[seat[bucket] == place]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  #: float32, one for each bucket, already scaled by the log-count ratio
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.array([self.weights[bucket].sum(dtype=np.float64) for bucket in present(texts)]) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def log_ratios(toxic: np.ndarray, other: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    """r of each feature, from the toxic and the other texts that have it."""
    return np.log((toxic + 1) / (positives + 2)) - np.log((other + 1) / (negatives + 2))


def chi_square(toxic: np.ndarray, other: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    """Of each feature and the classes, with one degree of freedom; 0 for a feature of no or of all texts."""
    share = (toxic + other) / (positives + negatives)
    spread = share * (1 - share) * (1 / positives + 1 / negatives)
    return np.where(spread > 0, (toxic / positives - other / negatives) ** 2 / np.maximum(spread, 1e-12), 0)


def fit(texts: pa.Array | pa.ChunkedArray, labels: np.ndarray) -> Model:
    y = labels.astype(np.float64)
    table = np.zeros(1 << BITS, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(table, float(np.log(share / (1 - share))))
    toxic, other = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    done = 0
    for part in chunks(texts, FIT_CHUNK):
        for bucket, label in zip(present(part), y[done : done + len(part)]):
            (toxic if label > 0 else other)[bucket] += 1
        done += len(part)
    positives = float(y.sum())
    counts = toxic, other, positives, len(y) - positives
    telling = chi_square(*counts) >= CHI_SQUARE
    x = np.where(telling, log_ratios(*counts), 0).astype(np.float32)
    # The telling features of all texts stay in the parts they were made in: (text numbers, sizes, buckets).
    parts, done = [], 0
    for part in chunks(texts, FIT_CHUNK):
        each = [b[telling[b]].astype(np.int32) for b in present(part)]
        parts.append((slice(done, done + len(part)), np.array([len(b) for b in each]), np.concatenate(each)))
        done += len(part)

    def loss(params: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean logistic loss with the ridge, and its gradient; the last parameter is the intercept."""
        scaled, total = params[:-1] * x, 0.0
        g = np.zeros(len(params), dtype=np.float32)
        for at, sizes, bucket in parts:
            owner = np.repeat(np.arange(len(sizes)), sizes)
            s = np.bincount(owner, weights=scaled[bucket], minlength=len(sizes)) + float(params[-1])
            miss = 1 / (1 + np.exp(-np.clip(s, -40, 40))) - y[at]
            np.add.at(g, bucket, miss.astype(np.float32)[owner])
            g[-1] += miss.sum()
            total += float((np.logaddexp(0, s) - y[at] * s).sum())
        g[:-1] *= x
        g /= len(y)
        g[:-1] += np.float32(RIDGE) * params[:-1]
        return total / len(y) + RIDGE / 2 * float(params[:-1] @ params[:-1]), g

    start = np.zeros((1 << BITS) + 1, dtype=np.float32)
    start[-1] = np.log(positives / (len(y) - positives))
    found = minimised(loss, start, STEPS)
    return Model(found[:-1] * x, float(found[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labels of documents that are not held out (crc32 of the id as text, mod 5, is not 0)."""
    usable = labels.where((crc32_of("doc_id") % 5 != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = labelled_sample(docs, usable, "toxic", FIT_ROWS)
    model = fit(sample["text"], sample["toxic"].to_numpy())
    del sample
    trimmed()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of each row."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.intercept))  # 4 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(np.frombuffer(shared.value[0], dtype=np.float32), shared.value[1])
        for batch in batches:
            parts = [known.scores(part) for part in chunks(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])
        trimmed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", (crc32_of("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that the classifier rejects, columns and rows otherwise as they are."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((lambda m: (m.weights.tobytes(), m.intercept))(train(docs, labels)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(np.frombuffer(shared.value[0], dtype=np.float32), shared.value[1])
        for batch in batches:
            parts = [known.scores(part) for part in chunks(batch["text"])]
            yield batch.filter(pa.array(np.concatenate(parts) < threshold if parts else np.zeros(0, bool)))
        trimmed()

    return docs.mapInArrow(keep, docs.schema)
