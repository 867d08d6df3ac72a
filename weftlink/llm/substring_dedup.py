"""Substring dedup over sliding runs of sentences.

A text is cut into sentences: after ``.``, ``!`` or ``?`` (and further ASCII punctuation) before white space, and at
line ends. Runs of ``run`` consecutive sentences or more are hashed (96 bits, over their words with A-Z read as a-z, so
the white space inside a sentence doesn't matter). Hashes are joined globally; the first occurrence of a run, by doc_id
and then place, stays, and every sentence that a later occurrence covers is removed. A run has ``least_words`` words at
least: half of all two-sentence runs of plain prose are a few words long ("The. Of it.") and repeat by chance, so a
short one is extended by further sentences until it has enough words. Each sentence starts the least run that reaches
forward and ends the least one that reaches back: every repeated passage of so many sentences and words is the union of
such runs and goes to both its ends. A text that holds no such run is one run as a whole: its copies go.

Cases: null and blank texts have no sentences; a null doc_id comes last in the order of occurrences; ties (repeated
rows, rows that share a doc_id) are broken by a hash of the text and a row number, so one of the equal rows stays; rows are
numbered once, in a written table;
a text whose sentences are all removed becomes empty; an empty table gives an empty result; other columns pass
through ``deduplicated`` unchanged, n_chars follows the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, text_batches, written
from .features import trimmed
from .kernels import mix, word_hashes

RUN, LEAST_WORDS = 2, 25
_END = re.compile(rb"(?:[.!?][!-/:-@\[-`{-~]*(?=[\x20\x09-\x0d])|\n)[\x20\x09-\x0d]*")
_SECOND = np.uint64(0xD1B54A32D192ED03)


def sentence_bounds(body: bytes) -> np.ndarray:
    """Start of each sentence in bytes, and the end of the text."""
    starts = [0, *(m.end() for m in _END.finditer(body))]
    if starts[-1] < len(body):
        starts.append(len(body))
    return np.array(starts, dtype=np.int64)


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def runs(body: bytes, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentences in the run, hash, second hash) of every run of a text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    bounds = sentence_bounds(body)
    count = len(bounds) - 1
    if count < 1:
        return none
    data = np.frombuffer(body, dtype=np.uint8)
    words = word_hashes(data)
    inside = np.ones(len(data) + 1, dtype=bool)
    inside[:-1] = ~np.isin(data, np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], np.uint8))
    inside[-1] = False
    begins = np.flatnonzero(inside[:-1] & ~np.concatenate([[False], inside[:-2]]))
    first_word = np.searchsorted(begins, bounds)  # words that start before each bound
    starts = np.arange(count)
    ends = np.maximum(np.searchsorted(first_word, first_word[:-1] + least_words), starts + run)
    spoken = first_word[1:] > first_word[:-1]
    keep = (ends <= count) & spoken
    # The same from each end backwards, as the last sentences of a passage start no run inside it.
    last = starts + 1
    begin = np.minimum(np.searchsorted(first_word, first_word[1:] - least_words, side="right") - 1, last - run)
    back = (begin >= 0) & spoken & spoken[begin] & ~(keep[begin] & (ends[begin] == last))
    starts, ends = np.concatenate([starts[keep], begin[back]]), np.concatenate([ends[keep], last[back]])
    if not len(starts):
        if not len(words):
            return none
        starts, ends = np.array([0]), np.array([count])
    # A run's hash is a polynomial over its words: prefix sums of word * base**place, shifted back to place 0.
    with np.errstate(over="ignore"):
        n = len(words)
        out = []
        for base, values in ((np.uint64(0x9E3779B97F4A7C15), words), (_SECOND, mix(words ^ _SECOND))):
            up, down = _powers(int(base), n + 1)
            sums = _prefix(values * up[:n])
            a, b = first_word[starts], first_word[ends]
            out.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
    return starts, ends - starts, out[0], out[1]


_KNOWN: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _KNOWN or len(_KNOWN[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        _KNOWN[base] = (pair[0], pair[1])
    return _KNOWN[base]


def run_table(docs: DataFrame, run: int, least_words: int) -> DataFrame:
    """``(doc_id, th, row, sentence, length, h1, h2)`` of every run; ``th`` and ``row`` tell rows of one doc_id apart."""

    text_batches(docs.sparkSession)
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = [], []
            own = [batch[c] for c in ("doc_id", "th", "row")]
            for i, text in enumerate(batch["text"]):
                body = text.as_buffer()
                if body is not None:
                    parts.append(runs(body.to_pybytes(), run, least_words))
                    rows.append(np.full(len(parts[-1][0]), i))
            if not parts:
                continue
            at = pa.array(np.concatenate(rows).astype(np.int64))
            start, length, h1, h2 = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [*[x.take(at) for x in own], pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                names=["doc_id", "th", "row", "sentence", "length", "h1", "h2"],
            )
        trimmed()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "row", "text")
    return rows.mapInArrow(hashed, "doc_id long, th long, row long, sentence int, length int, h1 long, h2 int")


def repeated_runs(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every non-first occurrence of a run: ``(doc_id, row, sentence, length, first_doc_id)``. ``docs`` has a ``row``."""
    table = written(run_table(docs, run, least_words), "sentence-runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "row", "sentence")
    first = table.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Written, so that both sides of the join are plain shuffles: a passage in very many documents is then split.
    first = written(first, "sentence-firsts")
    joined = table.join(first, ["h1", "h2"]).where(place > F.col("first"))
    return joined.select("doc_id", "row", "sentence", "length", F.col("first.doc_id").alias("first_doc_id"))


def removed_spans(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each maximal stretch of removed sentences: ``(doc_id, row, first_sentence, n_sentences, first_doc_ids)``.
    ``docs`` has a ``row``."""
    found = repeated_runs(docs.select("doc_id", "row", "text"), run, least_words)
    stretches = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("sentence", "length")).alias("runs"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"))  # at most two runs a sentence

    def merge(runs_: Column) -> Column:
        """Maximal stretches (a, b) of sorted runs: one starts where no run before it reaches."""
        reach = running(F.transform(runs_, lambda r: r["sentence"] + r["length"]), F.greatest)

        def cut(ends: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(runs_) - 1), lambda i: F.when(i > 0, F.get(runs_, i)["sentence"] > F.get(ends, i - 1)).otherwise(True))
            stretch = lambda s, i, k: F.struct(F.get(runs_, i)["sentence"].alias("a"), F.get(ends, F.coalesce(F.get(s, k + 1), F.size(ends)) - 1).alias("b"))
            return let(starts, lambda s: F.transform(s, lambda i, k: stretch(s, i, k)))

        return let(reach, cut)

    return stretches.select("doc_id", "row", F.inline(let(F.array_sort("runs"), merge)), "first_doc_ids").select("doc_id", "row", F.col("a").alias("first_sentence"), (F.col("b") - F.col("a")).alias("n_sentences"), "first_doc_ids")


def deduplicated(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the covered sentences of non-first runs removed; n_chars follows."""
    columns, schema = docs.columns, docs.schema
    rows = written(docs.withColumn("_weftlink_row", F.monotonically_increasing_id()), "sentence-rows")
    own = rows.select("doc_id", F.col("_weftlink_row").alias("row"), "text")
    spans = removed_spans(own, run, least_words).groupBy("row").agg(F.collect_list(F.struct("first_sentence", "n_sentences")).alias("_spans"))
    joined = rows.join(spans.select(F.col("row").alias("_weftlink_row"), F.col("_spans").alias("_weftlink_spans")), "_weftlink_row", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans_ in zip(batch["text"].to_pylist(), batch["_weftlink_spans"].to_pylist()):
                body = text.encode()
                bounds = sentence_bounds(body)
                keep = np.ones(len(bounds) - 1, dtype=bool)
                for s in spans_:
                    keep[s["first_sentence"] : s["first_sentence"] + s["n_sentences"]] = False
                out.append(b"".join(body[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(keep)).decode())
            arrays = [pa.array(out, pa.string()) if c == "text" else batch[c] for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    changed = joined.where("_weftlink_spans IS NOT NULL").select(*columns, "_weftlink_spans").mapInArrow(cut, schema)
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast("long"))
    return joined.where("_weftlink_spans IS NULL").select(*columns).unionByName(changed.select(*columns))


def contract(docs: DataFrame) -> DataFrame:
    """Removed stretches of every document that loses some, with the documents that hold their first occurrence."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")  # evaluated once, into the table of runs
    return removed_spans(rows).select("doc_id", "first_sentence", "n_sentences", "first_doc_ids")
