"""Draws without replacement by keyed hashes: the items with the least md5 of seed, record and item, in numpy.

An md5 of Spark or hashlib takes some half a microsecond with its texts; here a block of hashes goes through the rounds
at once, and the words of a message that records or items share are made once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# md5's constants, the rotations of its rounds, and the hashes of a block, which should fit a core's cache.
_K = np.array([int(abs(np.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)], dtype=np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)
_BLOCK = 16_384


def _first_words(words: list[np.ndarray | None], shape: tuple[int, int]) -> np.ndarray:
    """The first 64 bits of md5 as numbers of the same order, of messages of one block. ``words``: 16 arrays that
    broadcast to ``shape``, None for zeros."""
    a, b, c, d = (np.full(shape, x, dtype=np.uint32) for x in _START)
    f, t = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for i in range(64):
        part = i >> 4
        if part == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif part == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) & 15
        elif part == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) & 15
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (7 * i) & 15
        np.add(f, a, out=f)
        np.add(f, _K[i] if words[g] is None else words[g] + _K[i], out=f)
        turn = np.uint32(_TURNS[part][i & 3])
        np.left_shift(f, turn, out=t)
        np.right_shift(f, np.uint32(32) - turn, out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    high, low = (a + _START[0]).byteswap().astype(np.uint64), (b + _START[1]).byteswap()
    return (high << np.uint64(32)) | low


def _placed(texts: list[bytes], skip: int, end: bytes) -> np.ndarray:
    """Texts and ``end`` as rows of little-endian words, after ``skip`` zero bytes."""
    width = -(-(skip + max(map(len, texts)) + len(end)) // 4) * 4
    rows = b"".join((b"\0" * skip + x + end).ljust(width, b"\0") for x in texts)
    return np.frombuffer(rows, dtype="<u4").reshape(len(texts), width // 4).astype(np.uint32)


class Hashes:
    """Hashes of the same items for many records."""

    def __init__(self, seed: int, items: list[bytes]):
        self.seed, self.items, self.longest = str(seed).encode(), items, max(map(len, items))
        self.lengths, self.placed = np.array([len(x) for x in items], dtype=np.uint32), {}

    def of(self, heads: list[bytes]) -> np.ndarray:
        """Rows of the first 64 bits of md5; ``heads``: what stands before the items, of one length."""
        size = len(heads[0])
        if size + self.longest > 55:  # more than a block
            return np.array([[int.from_bytes(hashlib.md5(h + x).digest()[:8], "big") for x in self.items] for h in heads], dtype=np.uint64)
        if size % 4 not in self.placed:
            self.placed[size % 4] = _placed(self.items, size % 4, b"\x80")
        items, first, before = self.placed[size % 4], size // 4, _placed(heads, 0, b"")
        out = np.empty((len(heads), len(self.items)), dtype=np.uint64)
        for i in range(0, len(self.items), _BLOCK):
            part, n = items[i : i + _BLOCK], self.lengths[i : i + _BLOCK]
            words: list[np.ndarray | None] = [None] * 16
            for w in range(before.shape[1]):
                words[w] = before[:, w : w + 1]
            for w in range(part.shape[1]):
                own = part[:, w][None, :]
                words[first + w] = own if words[first + w] is None else words[first + w] | own
            words[14] = ((n + np.uint32(size)) * np.uint32(8))[None, :]
            out[:, i : i + _BLOCK] = _first_words(words, (len(heads), len(n)))
        return out

    def least(self, keys: np.ndarray, among: np.ndarray, k: int, head: bytes) -> np.ndarray:
        """Of ``among`` (places of items) the k with the least md5, then item."""
        if k >= len(among):
            return among
        of = keys[among]
        chosen = np.argpartition(of, k - 1)
        if (of[chosen[k:]] > of[chosen[k - 1]]).all():
            return among[chosen[:k]]
        return np.array(sorted(among.tolist(), key=lambda i: (hashlib.md5(head + self.items[i]).digest(), self.items[i]))[:k], dtype=np.int64)


def drawn(seed: int, records: list[str], k: list[int], own: list[str | None], items: list[str], at: pa.Array) -> list[np.ndarray]:
    """For each record the places of its k items: those whose address is there and another than the record's first, then
    by md5 of seed, record and item."""
    ids = [x.encode() for x in items]
    hashes, every = Hashes(seed, ids), np.arange(len(items))
    codes = pc.dictionary_encode(at.cast(pa.string()))
    code = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)
    known = {x: i for i, x in enumerate(codes.dictionary.to_pylist())}
    heads = [f"{seed}:{r}:".encode() for r in records]
    out: list[np.ndarray] = [every] * len(records)
    todo: dict[int, list[int]] = {}
    for i, h in enumerate(heads):
        if k[i] < len(items):
            todo.setdefault(len(h), []).append(i)
    step = max(1, _BLOCK // len(items))
    for same in todo.values():
        for few in (same[i : i + step] for i in range(0, len(same), step)):
            for i, keys in zip(few, hashes.of([heads[i] for i in few])):
                if own[i] is None:
                    out[i] = hashes.least(keys, every, k[i], heads[i])
                    continue
                first = (code >= 0) & (code != known.get(own[i], -2))
                best = np.flatnonzero(first)
                if len(best) >= k[i]:
                    out[i] = hashes.least(keys, best, k[i], heads[i])
                else:
                    out[i] = np.concatenate([best, hashes.least(keys, np.flatnonzero(~first), k[i] - len(best), heads[i])])
    return out
