"""Vectorised text kernels for Arrow batches: words, shingles and their hashes, straight from UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time (a longer word or document is worked on whole).
WINDOW = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Lower-cases A-Z and nothing else.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
# Fixed value: the six white-space characters between words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the polynomial's base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _INVERSE)):
                    steps = np.full(size, base, dtype=np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_POWERS = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of one text's bytes, in order, A-Z read as a-z."""
    if len(data) <= WINDOW:
        return _window_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        if end < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                after = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(after[0]) + 1 if len(after) else len(data)
        out.append(_window_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def _window_hashes(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edges[0::2], edges[1::2]
    _POWERS.need(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.cumsum(_BYTE_LOWER[data] * _POWERS.up[: len(data)], dtype=np.uint64)
        before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
        return mix((sums[end - 1] - before) * _POWERS.down[begin])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            return mix(np.array([(words * _PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
        out = words[: n - k + 1] * _PLACES[0]
        for i in range(1, k):
            out += words[i : n - k + 1 + i] * _PLACES[i]
    return np.unique(mix(out))


def bodies(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    """The bytes of a batch's texts, one after another."""
    data, offsets = utf8(batch[column])
    return (data[offsets[i] : offsets[i + 1]] for i in range(len(batch)))
