"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a sample of its labelled text recognises every substring of the sample. A
text is parsed greedily into the longest phrases that the sample contains; phrases times the bits that name a place
in the sample, log2(n + 1), and, for a symbol that the sample lacks, the bits that name one of the joint alphabet, over
the length of the text estimate the cross entropy of the text under the language. The language needing fewest bits
wins. Texts are read in lower case, letters as symbols, everything between letters as one space; they are cut into
segments of ``SEGMENT`` symbols that are parsed side by side, and the phrases of all segments of a text are added up,
so whole texts count.

Samples: ``FIT_DOCS`` whole documents of each language, those with the least hashed ids among the ones of at most
``FIT_LENGTH`` characters, and the shortest of the others where these are too few. Every letter of a sample is a symbol
of its own. Transitions are kept in a hash table, so an automaton takes some 100 bytes for each symbol of its sample.
A language whose sample has no letter is never predicted.

Cases: a null text or one without a letter is ``und`` with score 0; if nothing could be learned every text is;
ties go to the first language by code point; a null lang or doc_id is not learned from (a null id counts as crc32 0);
repeated rows are judged one by one; an empty table gives an empty result; columns that the operator doesn't use are
ignored. The score is the runner-up's entropy over the sum of both (one with a single language).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import small, text_batches
from .features import chunks, crc32_of, trimmed

FIT_DOCS, FIT_LENGTH = 48, 6000
SEGMENT = 256
SPACE = 0
_POINTS, _MEETINGS = 0x110000, 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(_POINTS)), dtype=bool, count=_POINTS)


def automaton(symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (from, symbol, to) of the suffix automaton; state 0 is the root, in which the parse starts."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
        last = new
    sizes = np.fromiter(map(len, go), np.int64, len(go))
    total = int(sizes.sum())
    return np.repeat(np.arange(len(go)), sizes), np.fromiter((c for x in go for c in x), np.int64, total), np.fromiter((t for x in go for t in x.values()), np.int64, total)


class Transitions:
    """The transitions of several automata in one open-addressed table: (state, symbol) to state, -1 if there is none."""

    def __init__(self, states: np.ndarray, symbols: np.ndarray, to: np.ndarray, width: int) -> None:
        bits = max(4, int(2 * len(to) + 1).bit_length())
        self.width, self.shift, self.mask = width, np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.to = np.full(1 << bits, -1, dtype=np.int32)
        left, place = states * width + symbols, None
        values = to
        while len(left):
            place = self._home(left) if place is None else (place + 1) & self.mask
            free = self.keys[place] < 0
            self.keys[place[free]] = left[free]
            mine = self.keys[place] == left  # of several that wanted a place one has it now
            self.to[place[mine]] = values[mine]
            left, values, place = left[~mine], values[~mine], place[~mine]

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = states * self.width + symbols
        place = self._home(key)
        held = self.keys[place]
        out = self.to[place]
        odd = np.flatnonzero(held != key)
        out[odd] = -1
        odd = odd[held[odd] >= 0]
        place = place[odd]
        while len(odd):
            place = (place + 1) & self.mask
            held = self.keys[place]
            hit = held == key[odd]
            out[odd[hit]] = self.to[place[hit]]
            again = ~hit & (held >= 0)
            odd, place = odd[again], place[again]
        return out


@dataclass(frozen=True)
class Model:
    langs: list[str]
    alphabet: str  #: the letters of all samples; the place in it plus one is the symbol
    lengths: np.ndarray  #: symbols of each sample
    roots: np.ndarray
    table: Transitions | None


def lookup(alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """(whether a code point is a letter, its symbol); letters of no sample share one more symbol."""
    letters = letter_table()
    symbol = np.where(letters, np.int32(len(alphabet) + 1), np.int32(SPACE))
    for i, ch in enumerate(alphabet):
        symbol[ord(ch)] = i + 1
    return letters, symbol


def symbols_of(texts: list[str], letters: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, offsets, whether a text has a letter); runs of spaces count once."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in lower])
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = symbol[codes]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    has = np.bincount(owner[letters[codes]], minlength=len(texts)) > 0
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != SPACE) | (out[:-1] != SPACE)
    keep[begins[begins < len(out)]] = True
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))]).astype(np.int64)
    return out[keep], offsets, has


class Parser:
    """Parses texts by the automata of all languages at once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.letters, self.symbol = lookup(model.alphabet)
        self.unseen_bits = np.log2(len(model.alphabet) + 2)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by language and text, those of them that are an unseen symbol, symbols by text, whether a text has a letter)."""
        symbols, offsets, has = symbols_of(texts, self.letters, self.symbol)
        roots = self.model.roots[:, None]
        sizes = np.diff(offsets)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[:-1][owner] + within * SEGMENT
        size = np.minimum(offsets[1:][owner] - begin, SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        count, unseen = (np.zeros((len(roots), len(owner)), dtype=np.int64) for _ in range(2))
        state = np.repeat(roots, len(owner), axis=1)
        fresh = np.ones_like(state, dtype=bool)  # no phrase is open
        active = len(owner) - np.searchsorted(size[::-1], np.arange(SEGMENT), side="right")
        for t in range(SEGMENT):
            m = active[t]
            if not m:
                break
            c = np.broadcast_to(symbols[begin[:m] + t].astype(np.int64), (len(roots), m)).reshape(-1)
            now = state[:, :m].reshape(-1)
            new = self.model.table(now, c).astype(np.int64)
            miss = np.flatnonzero(new < 0)
            ended = ~fresh[:, :m].reshape(-1)[miss]
            root = roots[miss // m, 0]
            again = np.where(ended, -1, new[miss])
            again[ended] = self.model.table(root[ended], c[miss[ended]])
            lang, at = miss // m, miss % m
            none = again < 0
            count[lang, at] += ended.astype(np.int64) + none
            unseen[lang[none], at[none]] += 1
            new[miss] = np.where(none, root, again)
            state[:, :m] = new.reshape(len(roots), m)
            open_ = np.ones(len(new), dtype=bool)
            open_[miss[none]] = False
            fresh[:, :m] = ~open_.reshape(len(roots), m)
        count += ~fresh
        total = lambda x: np.stack([np.bincount(owner, weights=y, minlength=len(texts)) for y in x])
        return total(count), total(unseen), sizes, has

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs = self.model.langs
        if not langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        count, unseen, sizes, has = self.phrases(texts)
        entropy = (count * np.log2(self.model.lengths + 1)[:, None] + unseen * self.unseen_bits) / np.maximum(sizes, 1)
        best = entropy.argmin(axis=0)
        if len(langs) == 1:
            score = np.ones(len(texts))
        else:
            two = np.sort(entropy, axis=0)[:2]
            score = two[1] / np.maximum(two.sum(axis=0), 1e-12)
        return [langs[b] if ok else "und" for b, ok in zip(best, has)], np.where(has, score, 0.0)


def fit(samples: dict[str, list[str]]) -> Model:
    """One automaton for each language with a letter, from its sample texts in order."""
    letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
    alphabet = "".join(letters)
    reader = lookup(alphabet)
    langs, lengths, roots, parts = [], [], [], []
    base = 0
    for lang in sorted(samples):
        symbols, _, has = symbols_of(samples[lang], *reader) if samples[lang] else (np.zeros(0, np.int32), None, np.zeros(0, bool))
        if not has.any():
            continue
        states, on, to = automaton(symbols.tolist())
        parts.append((states + base, on, to + base))
        langs.append(lang)
        lengths.append(len(symbols))
        roots.append(base)
        base += int(to.max()) + 1
    table = Transitions(*(np.concatenate(x) for x in zip(*parts)), len(alphabet) + 2) if parts else None
    return Model(langs, alphabet, np.array(lengths, dtype=np.float64), np.array(roots, dtype=np.int64), table)


def train(docs: DataFrame) -> Model:
    """Learn from documents with a lang that are not held out (crc32 of the id as text, mod 4, is not 2)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc32_of("doc_id") % 4 != 2))
    order = F.greatest(F.col("_n"), F.lit(FIT_LENGTH)), F.xxhash64("doc_id"), F.col("doc_id"), F.col("_h")
    ids = known.select("doc_id", F.col("lang").alias("_lang"), F.length("text").alias("_n"), F.xxhash64("text").alias("_h")).distinct()
    # The first of each partition meet in _MEETINGS tasks a language, the first of those in one.
    ids = ids.withColumn("_part", F.spark_partition_id() % _MEETINGS)
    for group in (["_lang", "_part"], ["_lang"]):
        ids = ids.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_at") <= FIT_DOCS)
    ids = ids.select("doc_id", "_lang", "_h")
    picked = known.select("doc_id", "lang", "text", F.xxhash64("text").alias("_t")).join(small(ids), "doc_id").where("lang = _lang AND _t = _h")
    samples: dict[str, list[str]] = {}
    rows = picked.groupBy("lang", "doc_id", "_t").agg(F.first("text").alias("text")).orderBy("lang", F.xxhash64("doc_id"), "_t")  # FIT_DOCS a language at most
    for lang, text in rows.select("lang", "text").toArrow().to_pandas().itertuples(index=False):
        samples.setdefault(lang, []).append(text)
    model = fit(samples)
    trimmed()
    return model


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 100 bytes for each symbol of the samples

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        for batch in batches:
            langs: list[str] = []
            scores = [np.zeros(0)]
            for part, empty in _parts(batch["text"]):
                found, score = parser.judge(part)
                langs += ["und" if e else x for x, e in zip(found, empty)]
                scores.append(np.where(empty, 0.0, score))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=["doc_id", "lang_pred", "score"])
        trimmed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")


def _parts(column: pa.Array) -> Iterator[tuple[list[str], np.ndarray]]:
    for part in chunks(column):
        yield part, np.array([not t for t in part], dtype=bool)


def contract(docs: DataFrame) -> DataFrame:
    out = identified(docs, train(docs))
    return out.select("doc_id", (crc32_of("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")
