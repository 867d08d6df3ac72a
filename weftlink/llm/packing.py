"""Best-fit packing of tokenised documents into fixed-length sequences, by hierarchical residual packing.

Documents become token ids plus one end id; only those longer than a sequence are cut, into full pieces and a last
one. Pieces are packed best-fit decreasing inside a partition. Nearly full sequences are emitted; an underfull one
becomes an item, as long as what it holds, and items of ``FAN`` neighbouring groups meet in the next round, and so on
up the tree. The fill that counts as nearly full falls from round to round, the last round emits all.

An item of a later round holds at least one piece and at most ``capacity`` tokens, so what a group carries on is
bounded by its underfull sequences; where more than ``MOST_ITEMS`` items would meet, in a partition or further up, they
are dealt by hash over several groups of about that size, and the others go up the tree as ever. Each such group leaves
at most one sequence that is half full or less.

Ids are those of the tokenizer's plain call: the strings of its special tokens become their ids.

Cases: a null text is empty and packs as its end id alone; a null doc_id is kept; repeated rows are packed as often
as they occur; equal lengths are placed in order of doc_id and piece; an empty table gives an empty result; columns
that the operator doesn't use are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, text_batches, written
from .features import trimmed

CAPACITY, END_ID = 4096, 1
#: Neighbouring groups that meet in a round, and the items beyond which those that meet are dealt over several groups.
FAN, MOST_ITEMS = 8, 200_000
#: Share of the capacity from which a sequence is emitted, by round; the last one holds for later rounds too.
FULL = (0.998, 0.99, 0.97)
#: Words and pieces of words whose ids a worker keeps (in two generations of so many: the older one goes when the newer is full).
CACHED = 200_000

# What the tokenizer file's pattern does to lower-case words of Latin letters; other words go to it whole.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_BREAKS = re.compile("[\x20\x09-\x0d]+")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others after 255.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_STANDS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class _Cache:
    """A dictionary of bounded size that keeps what was used lately."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in order; words
    are looked up, then their pieces, and only unknown pieces reach the tokenizer's vocabulary. Words with characters
    beyond Latin letters go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        added = self._tokenizer.get_added_tokens_decoder()
        self._special = {token.content: struct.pack("<I", i) for i, token in added.items()}
        self._cuts = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")")
        # Tokens that are matched in normalised text or take white space with them need the whole tokenizer.
        self._exact = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        self._ids = _Cache(CACHED)

    def _known(self, word: str) -> bytes:
        """Ids of a word or a piece of one, in lower case unless it goes to the tokenizer."""
        out = self._ids.new.get(word)
        if out is not None:
            return out
        out = self._ids.old.get(word)
        if out is None:
            if not _PLAIN.fullmatch(word):
                out = np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
            elif len(pieces := _PIECES.findall(word)) > 1:
                out = b"".join(map(self._known, pieces))
            else:
                shown = word if word.isascii() else "".join(map(_STANDS.__getitem__, word.encode()))
                ids = [token.id for token in self._model.tokenize(shown)]
                out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self._ids.put(word, out)
        return out

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._exact:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if any(x in text for x in self._special):
            parts = self._cuts.split(text)
            return b"".join(self._special[x] if i % 2 else self._plain(x) for i, x in enumerate(parts) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if lowered := "Σ" not in text:  # the one letter whose lower case depends on its neighbours
            text = text.lower()
        split = _BREAKS.split(text) if any(c in text for c in _ODD) else text.split()
        out = list(map(self._ids.new.get, split))
        if None in out:
            known = self._known
            if not lowered:
                split = [w.lower() if _PLAIN.fullmatch(w) else w for w in split]
            out = [known(w) if x is None else x for w, x in zip(split, out)]
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, home)``; ``home`` is the partition that made the piece."""
    text_batches(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text, home in zip(batch["doc_id"].to_pylist(), batch["text"], batch["home"].to_pylist()):
                ids = encode(text.as_py()) + end
                for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    rows.append((doc_id, piece, lo // 4, len(part) // 4, zlib.crc32(part), home))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "home"])
        trimmed()

    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("home")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, home int")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers by sequence. Ties keep their order."""
    open_room: list[int] = []  # distinct rooms left, ascending
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(open_room, size)
        if at == len(open_room):
            bins.append([i])
            b, room = len(bins) - 1, capacity
        else:
            room = open_room[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                open_room.pop(at)
            bins[b].append(i)
        if room := room - size:
            if room not in by_room:
                by_room[room] = []
                insort(open_room, room)
            by_room[room].append(b)
    return bins


_ITEM = "home int, salt int, size long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def _round(items: DataFrame, capacity: int, full: float) -> DataFrame:
    """Pack the items of each group; ``done`` marks sequences that are emitted."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        members = group["members"].tolist()
        sizes = group["size"].to_numpy(np.int64)
        first = [(m[0]["doc_id"] is None, m[0]["doc_id"] or 0, m[0]["piece"], m[0]["start"]) for m in members]
        order = sorted(range(len(members)), key=first.__getitem__)  # the result doesn't depend on the order of arrival
        bins = best_fit(sizes[order], capacity)
        held = [[order[i] for i in b] for b in bins]
        total = [int(sizes[b].sum()) for b in held]
        filled = []
        for b in held:
            content, at = [], 0
            for x in (x for i in b for x in members[i]):
                content.append({**x, "offset": at})
                at += x["length"]
            filled.append(content)
        return pd.DataFrame({"home": group["home"].iloc[0], "salt": group["salt"].iloc[0], "size": total, "members": filled, "done": [t >= full * capacity for t in total]})

    return items.groupBy("home", "salt").applyInPandas(pack, _ITEM + ", done boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, home) with ``sequence_id`` and ``offset``."""
    pieces = written(pieces, "pack-pieces")

    def dealt(left: DataFrame) -> DataFrame:
        """``left`` (home, h, size, members) with ``salt``: a group of a home that is too large is dealt over several."""
        deals = left.groupBy(F.col("home").alias("_home")).agg(F.ceil(F.count(F.lit(1)) / MOST_ITEMS).alias("deals"))  # a row for each home
        return left.join(small(deals), F.col("home") == F.col("_home")).select("home", F.pmod("h", "deals").cast("int").alias("salt"), "size", "members")

    one = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset")))
    items = dealt(pieces.select("home", F.xxhash64("doc_id", "piece", "start", "ids_crc32").alias("h"), F.col("length").alias("size"), one.alias("members")))
    emitted: list[DataFrame] = []
    turn = 0
    while True:
        packed = written(_round(items, capacity, FULL[min(turn, len(FULL) - 1)]), f"pack-round{turn}")
        left = packed.where("NOT done")
        emitted.append(packed.where("done"))
        if left.select("home").distinct().limit(2).count() < 2:
            emitted.append(left)
            break
        items = dealt(left.select(F.floor(F.col("home") / FAN).cast("int").alias("home"), F.xxhash64("home", "salt", "members").alias("h"), "size", "members"))
        turn += 1
    out = emitted[0]
    for more in emitted[1:]:
        out = out.unionByName(more)
    numbered = out.withColumn("sequence_id", F.monotonically_increasing_id())
    return numbered.select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def contract(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(tokenized(docs, tokenizer))
