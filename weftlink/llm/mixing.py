"""Mixing sources to target weights by blocks.

The words of a source, its documents in order of doc_id, form one stream that is cut into blocks of ``block`` words.
Targets: sources in code point order, null last, weigh 1, 2, 3 repeating and share all words; a target stops at
``most`` times its source's size and the excess is shared out again by weight. The output is a sequence of slots, a
block each, dealt over shards. For every shard the counts of its sources are drawn from a multinomial over what the
sources have left of their slots. Slots of a source are numbered through; number q stands for pass q div blocks, and a
keyed Feistel permutation of that pass maps q mod blocks to the block taken. Blocks and slots are joined by (source,
block). A source has as many slots as its target needs, and the last one takes only the words that are still missing:
what is taken of a source is its target, rounded to a word, however small the source is.

Sources are drawn in groups of ``FAN``, groups in groups of ``FAN`` and so on: a multinomial over groups, then one inside
each group in a task of its own, is the multinomial over all. So the driver sees at most ``FAN`` rows, whatever the
number of sources.

Cases: a null text has no words and is never taken; a null source is a source of its own, last in order; a null
doc_id comes first in its source; ties of doc_id are broken by a hash of the text, and equal rows are interchangeable;
with no words at all nothing is taken; an empty table gives an empty result; other columns are kept by ``mixed`` and
ignored elsewhere. Rows are numbered once, in a written table, so any input will do. Results depend only on the rows
and the seed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import NULL_KEY, running_offset, small, words, written

BLOCK, MOST, SEED = 64, 3, 20_011
#: Output shards: one for each so many slots, but no more than the second number; then shards grow.
SHARD_SLOTS, SHARDS = 4096, 4096
#: Sources, or groups of them, whose counts are drawn together.
FAN = 1000
_ROUNDS = 4


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``(source, source_size, target, ...)`` from ``(source, source_size)``, a row for each source."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    # Sources reach their caps in the order of cap/weight; the level is what a unit of weight gets once those before are full.
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (weights - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", level).withColumn("over", F.col("level") * F.col("weight") >= F.col("cap"))
    s = s.withColumn("final", F.min(F.when(~F.col("over"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    full = F.col("final").isNull() | (F.col("final") * F.col("weight") >= F.col("cap"))
    return s.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def _permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n): a Feistel network on the next even power of two, walked into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    h = np.uint64(half)

    def turn(v: np.ndarray, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            v = v + np.uint64((key + 0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)
            v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (v ^ (v >> np.uint64(31))) & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & mask
        for i in reversed(range(_ROUNDS)) if inverse else range(_ROUNDS):
            left, right = (right ^ turn(left, i), left) if inverse else (right, left ^ turn(right, i))
        return (left << h) | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _source_key(sid: int, turn: int, seed: int) -> int:
    return int(np.random.SeedSequence([seed, sid, turn]).generate_state(1, np.uint64)[0])


def slots_needed(target: float, size: int, blocks: int, block: int, sid: int, seed: int) -> tuple[int, int]:
    """(slots of a source, words of its last slot): whole passes, then blocks of one more pass until the target is met."""
    if not size:
        return 0, 0
    passes = int(target // size)
    rest = int(round(target - passes * size))
    if not rest:
        return passes * blocks, block
    # The short last block of the source comes at one place of the pass; every other place holds a whole block.
    short = block * blocks - size
    place = int(_permute(np.array([blocks - 1]), blocks, _source_key(sid, passes, seed), inverse=True)[0])
    n = -(-rest // block)
    if place < n and n * block - short < rest:
        n += 1
    before = (n - 1) * block - (short if place < n - 1 else 0)
    return passes * blocks + n, rest - before


def planned(sizes: DataFrame, block: int, seed: int) -> DataFrame:
    """``sizes`` (sid, source_size, target, ...) with ``blocks``, ``quota`` (slots) and ``cut`` (words of the last slot)."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [slots_needed(t, int(n), int(b), block, int(s), seed) for t, n, b, s in zip(batch["target"], batch["source_size"], batch["blocks"], batch["sid"])]
            yield pd.DataFrame({"sid": batch["sid"], "quota": [r[0] for r in rows], "cut": [r[1] for r in rows]})

    sizes = sizes.withColumn("blocks", F.ceil(F.col("source_size") / block))
    needs = sizes.select("sid", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "blocks").mapInPandas(plan, "sid long, quota long, cut long")
    return sizes.join(needs, "sid")


def draw_shards(quota: np.ndarray, sizes: np.ndarray, seed: list[int]) -> np.ndarray:
    """Counts (shards, sources): multinomial draws in proportion to what each source has left.

    A draw beyond what is left is drawn again among the others; the sizes of the shards add up to the quotas, so
    columns sum to the quotas and rows to the sizes.
    """
    rng, left = np.random.default_rng(seed), quota.astype(np.int64).copy()
    out = np.zeros((len(sizes), len(quota)), dtype=np.int64)
    for take, missing in zip(out, sizes.tolist()):
        while missing:
            free = left - take
            drawn = np.minimum(rng.multinomial(missing, free / free.sum()), free)
            take += drawn
            missing -= int(drawn.sum())
        left -= take
    return out


_COUNTS = "node long, shard long, n long"


def shard_counts(quotas: DataFrame, seed: int) -> DataFrame:
    """``(node, shard, n)``: the slots that each shard gets from each source. ``quotas``: (node, quota), nodes from 1 on."""
    spark = quotas.sparkSession
    levels = [written(quotas.where("quota > 0").select("node", "quota"), "mix-level")]
    while levels[-1].limit(FAN + 1).count() > FAN:
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.sum("quota").alias("quota"))
        levels.append(written(up, "mix-level"))
    top = levels[-1].orderBy("node").toPandas().astype("int64")  # FAN rows at most
    total = int(top["quota"].sum())
    per_shard = max(SHARD_SLOTS, -(-total // SHARDS))
    sizes = np.minimum(per_shard, total - np.arange(0, total, per_shard))
    counts = draw_shards(top["quota"].to_numpy(), sizes, [seed, len(levels)])
    at = np.argwhere(counts > 0)
    table = pd.DataFrame({"node": top["node"].to_numpy()[at[:, 1]], "shard": at[:, 0], "n": counts[at[:, 0], at[:, 1]]}).astype("int64")  # SHARDS rows a node at most
    drawn = spark.createDataFrame(table, _COUNTS)
    for height in range(len(levels) - 1, 0, -1):
        below = levels[height - 1].withColumn("up", F.floor(F.col("node") / FAN))
        drawn = written(drawn.groupBy("node").cogroup(below.groupBy("up")).applyInPandas(_drawn_inside(seed, height), _COUNTS), "mix-counts")
    return drawn


def _drawn_inside(seed: int, height: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Deal what each shard gets from a group of sources to its members."""

    def inside(mine: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        mine, members = mine.sort_values("shard"), members.sort_values("node")
        counts = draw_shards(members["quota"].to_numpy(), mine["n"].to_numpy(), [seed, height, int(mine["node"].iloc[0])])
        at = np.argwhere(counts > 0)
        return pd.DataFrame({"node": members["node"].to_numpy()[at[:, 1]], "shard": mine["shard"].to_numpy()[at[:, 0]], "n": counts[at[:, 0], at[:, 1]]})

    return inside


def slots(plan: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``(shard, sid, turn, block, words)``: what every output slot takes. ``plan``: see ``planned``."""
    counts = shard_counts(plan.select(F.col("sid").alias("node"), "quota"), seed)
    before = Window.partitionBy("node").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # SHARDS rows a source at most
    table = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shape = plan.select("sid", "blocks", "quota", "cut")
    table = written(table.join(small(shape), table["node"] == shape["sid"]).select("shard", "sid", "blocks", "quota", "cut", "first", "n"), "mix-shards")
    shards = table.select("shard").distinct().count()
    tasks = max(1, min(shards, int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # few bytes, but much to make of them

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, sid, blocks, quota, cut, begin, n in batch.itertuples(index=False):
                for lo in range(begin, begin + n, 1 << 16):
                    q = np.arange(lo, min(lo + (1 << 16), begin + n), dtype=np.int64)
                    turn = q // blocks
                    taken = np.empty_like(q)
                    for t in np.unique(turn):
                        here = turn == t
                        taken[here] = _permute(q[here] % blocks, int(blocks), _source_key(int(sid), int(t), seed))
                    yield pd.DataFrame({"shard": shard, "sid": sid, "turn": turn, "block": taken, "words": np.where(q == quota - 1, cut, block)})

    return table.repartition(tasks, "shard").mapInPandas(expand, "shard long, sid long, turn long, block long, words long")


def numbered(docs: DataFrame, size: Column) -> DataFrame:
    """``(row, doc_id, source, size)`` and the columns of ``docs`` in ``given``: rows get their numbers here, once.

    ``row`` orders the rows of a source: by doc_id, by a hash of the text, by a number.
    """
    number = F.struct(F.coalesce(F.col("doc_id"), F.lit(NULL_KEY)).alias("key"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    return docs.select(number.alias("row"), "doc_id", "source", size.cast("long").alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"))


def taken_parts(rows: DataFrame, block: int = BLOCK, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """From written rows (row, doc_id, source, size): (documents, parts). documents: row, doc_id, size, source_size,
    target, sid, at (words before it in its source). parts: row, size, turn, start, n (a run of words of the document
    inside one taken block)."""
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    plan = plan.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    plan = written(planned(written(plan, "mix-targets"), block, seed), "mix-plan")
    known = plan.select(F.col("source").alias("_source"), "source_size", "target", "sid")
    placed = rows.join(small(known), rows["source"].eqNullSafe(known["_source"])).select("row", "doc_id", "size", "source_size", "target", "sid")
    placed = written(running_offset(placed, "sid", "row", "size", "at"), "mix-offsets")
    spans = placed.where("size > 0").select("row", "size", "sid", "at", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    begin = F.col("block") * block
    spans = spans.select("row", "size", "sid", "block", F.greatest(begin - F.col("at"), F.lit(0)).alias("start"), F.least(begin + block - F.col("at"), F.col("size")).alias("end"), F.greatest(F.col("at") - begin, F.lit(0)).alias("ahead"))
    drawn = slots(plan, block, seed).select("sid", "block", "turn", "words")
    n = F.least(F.col("end") - F.col("start"), F.col("words") - F.col("ahead"))
    # Slots are made from a small table, so their size would be underestimated and they would be broadcast.
    parts = spans.join(drawn.hint("merge"), ["sid", "block"]).select("row", "size", "turn", "start", n.alias("n")).where("n > 0")
    return placed, parts


def mix(docs: DataFrame, block: int = BLOCK, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    rows = written(numbered(docs, F.size(words(F.col("text")))).drop("given"), "mix-rows")
    placed, parts = taken_parts(rows, block, most, seed)
    taken = parts.groupBy("row").agg(F.sum("n").alias("taken"))
    out = placed.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def _cut(text: str, ranges: list[list[int]], at: list[tuple[int, int]]) -> str:
    """The given word ranges of a text, each with the white space inside it, joined by line ends."""
    return "\n".join(text[at[a][0] : at[a + n - 1][1]] for a, n in ranges)


def mixed(docs: DataFrame, block: int = BLOCK, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each pass that takes words of a document.

    A pass that takes all of a document returns its text as it is; else the taken runs, in order, a line each.
    """
    columns = docs.columns
    rows = written(numbered(docs, F.size(words(F.col("text")))), "mix-rows")
    _, parts = taken_parts(rows.drop("given"), block, most, seed)
    passes = parts.groupBy("row", "turn", "size").agg(F.sum("n").alias("_weftlink_n"), F.sort_array(F.collect_list(F.struct("start", "n"))).alias("_weftlink_runs"))  # as many runs as the document has blocks
    passes = passes.select(F.col("row.row").alias("_weftlink_row"), F.col("turn").alias("_weftlink_turn"), (F.col("_weftlink_n") == F.col("size")).alias("_weftlink_whole"), F.when(F.col("_weftlink_n") < F.col("size"), F.col("_weftlink_runs")).alias("_weftlink_runs"))
    given = rows.select(F.col("row.row").alias("_weftlink_row"), *[F.col(f"given.`{c}`") for c in columns])
    joined = given.join(passes, "_weftlink_row").drop("_weftlink_row", "_weftlink_turn")
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch["text"].to_pylist(), batch["_weftlink_runs"].to_pylist()):
                merged: list[list[int]] = []
                for r in runs:
                    if merged and merged[-1][0] + merged[-1][1] == r["start"]:
                        merged[-1][1] += r["n"]
                    else:
                        merged.append([r["start"], r["n"]])
                texts.append(_cut(text, merged, [m.span() for m in word.finditer(text)]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch[c] for c in columns], names=columns)

    whole = joined.where("_weftlink_whole").select(*columns)
    partial = joined.where("NOT _weftlink_whole").select(*columns, "_weftlink_runs").mapInArrow(cut, docs.schema)
    if "n_chars" in columns:
        partial = partial.withColumn("n_chars", F.length("text").cast("long"))
    return whole.unionByName(partial.select(*columns))


def contract(docs: DataFrame) -> DataFrame:
    return mix(docs)
