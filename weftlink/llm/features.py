"""Hashed character n-grams of Arrow text batches, vectorised over many texts at once, and labelled samples."""

from __future__ import annotations

import ctypes
import gc
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are worked on at a time (a longer text is worked on whole).
CHUNK = 1 << 19
_MULTIPLIERS = np.random.Generator(np.random.PCG64(4242)).integers(1, 1 << 31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points with A-Z read as a-z, and the offsets of the texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = codes + ((codes >= 65) & (codes <= 90)).astype(np.uint32) * np.uint32(32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return codes, offsets


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[list[str]]:
    """The texts of a column (nulls are empty), in lists of about ``most`` characters."""
    now: list[str] = []
    size = 0
    for text in column:
        text = text.as_py() or ""
        if now and size + len(text) > most:
            yield now
            now, size = [], 0
        now.append(text)
        size += len(text)
    if now:
        yield now


def gram_buckets(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point, those across two texts included."""
    count = max(0, len(codes) - n + 1)
    with np.errstate(over="ignore"):
        h = codes[:count] * _MULTIPLIERS[0] + np.uint32(n * 0x01000193)
        for i in range(1, n):
            h += codes[i : i + count] * _MULTIPLIERS[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def ngrams(codes: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every n-gram that lies inside one text."""
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = owner[: len(codes) - n + 1] == owner[n - 1 :]
    return gram_buckets(codes, n, bits)[ok], owner[: len(codes) - n + 1][ok]


def crc32_of(id_column: str) -> Column:
    """crc32 of the id written as text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")), F.lit(0))


def trimmed() -> None:
    """Give freed memory back to the system: fitting shares the driver with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    """A minimum of a convex function that gives (value, gradient): limited-memory BFGS with halved steps."""
    value, g = loss(at)
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    for _ in range(steps):
        d, alphas = -g, []
        for s, y, rho in reversed(past):
            alphas.append(rho * float(s @ d))
            d = d - alphas[-1] * y
        if past:
            s, y, rho = past[-1]
            d = d / (rho * float(y @ y))
        for (s, y, rho), alpha in zip(past, reversed(alphas)):
            d = d + (alpha - rho * float(y @ d)) * s
        slope, rate = float(d @ g), 1.0 if past else 1 / max(float(np.sqrt(g @ g)), 1e-12)
        if slope >= 0:
            break
        for _ in range(20):
            there = at + np.asarray(rate, at.dtype) * d.astype(at.dtype)
            then, h = loss(there)
            if then <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = there - at, h - g
        if (sy := float(s @ y)) > 1e-12:
            past.append((s, y, 1 / sy))
        done = abs(value - then) <= 1e-7 * max(1.0, abs(value))
        at, value, g = there, then, h
        if done:
            break
    return at


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> pa.Table:
    """``(text, <label>)`` of at most ``rows`` labelled documents, those with the least hashes of their ids.

    ``labels`` has a row for each doc_id. The ids are limited first, and of several rows of an id one is taken (the least
    text), so the broadcast and what reaches the driver are bounded by ``rows``.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", label).agg(F.min("text").alias("text")).orderBy("doc_id").select("text", label).toArrow()
