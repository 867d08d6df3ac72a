"""MinHash near-duplicate groups, verified by odd sketches and then by full shingle sets.

Words are runs of non-space characters with A-Z read as a-z; a document's set holds its distinct k-word shingles, or
its whole word sequence as one if it has fewer words. Documents with 100 * |A and B| >= 100 * threshold * |A or B| are
linked; groups are the connected components.

1. Equal sets fold into one class each, represented by its least row (doc_id, then a hash of the text).
2. Every class has 512 MinHash samples. The first 160 make 32 bands of five, its buckets; at a similarity of 0.8 a pair
   misses all of them once in 300,000. Folding all samples into a 2048-bit parity map gives its odd sketch: the
   population count of two sketches' XOR estimates their similarity.
3. Rounds of pivots: in each bucket with members of more than one group a pivot is chosen, and each member of another
   group is compared with one of its pivots, first by sketch, then by full sets. Links merge groups. A large group of
   near copies becomes one in a few rounds, with a number of pairs in proportion to its members.
4. What is left, members of one bucket but of different groups, meets bucket by bucket in blocks of a bounded number of
   members and shingles. The sketches tell which members are in an undecided pair at all; only these get their texts,
   and the block that holds both confirms such a pair on full sets. A block gives only links that join two of its
   groups, so fewer rows than it has members, however many pairs it compares; no pair of a bucket goes unchecked.

Cases: null and blank texts have empty sets and are linked with nothing; a null doc_id counts as the least id, and
its row is its own group if nothing is linked to it; rows that share a doc_id and nothing else are judged one by one,
each on its own text; repeated rows are in one group, and ``deduplicated`` leaves one of them; an empty table gives an
empty result; columns that the operator doesn't use are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, small, text_batches, written
from .components import components
from .features import trimmed
from .kernels import bodies, mix, shingles, word_hashes

SHINGLE_WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, SAMPLES, SKETCH_BITS = 32, 5, 512, 2048
#: A pair is verified unless its sketches put it this far below the threshold (nearly five standard deviations).
MARGIN = 0.095
#: Members and shingles (of all its members) that a block of a bucket holds, and rounds of pivots before that.
BLOCK, BLOCK_SHINGLES, PIVOT_ROUNDS = 512, 1 << 21, 4
#: Pairs that are compared at a time.
_PAIRS = 1 << 15

_RNG = np.random.Generator(np.random.PCG64(77))
_A = (_RNG.integers(1, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]
_SEATS = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
_BAND_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEPS = mix(np.arange(11, 11 + ROWS, dtype=np.uint64)) | np.uint64(1)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The samples of a set of 64-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 256):
            np.minimum(least, (_A * x[None, i : i + 256] + _B).min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((samples[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * _STEPS).sum(axis=1, dtype=np.uint64) + _BAND_SEEDS).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity map in 64-bit words: the bit of each (place, sample) is flipped."""
    bit = (mix(samples.astype(np.uint64) | _SEATS) >> np.uint64(65 - SKETCH_BITS.bit_length())).astype(np.int64)
    odd = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def most_flipped(similarity: float) -> int:
    """XOR population count that sketches of two sets of this similarity have on average."""
    differing = 2 * SAMPLES * (1 - similarity)
    return int(np.ceil(SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** differing) / 2))


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``(key, th, n, d1, d2, sketch, bands)`` of each row; d1 and d2 identify the set, th the text of a key."""
    text_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sketches, bands = [], [], [], [], []
            for body in bodies(batch, "text"):
                h = shingles(word_hashes(body), shingle_words)
                n.append(len(h))
                d1.append(h.sum(dtype=np.uint64))
                d2.append(mix(h ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64))
                if len(h):
                    samples = minhash(h)
                    sketches.append(odd_sketch(samples))
                    bands.append(band_keys(samples))
                else:
                    sketches.append(np.zeros(0, np.int64))
                    bands.append(np.zeros(0, np.int64))

            def lists(x: list[np.ndarray]) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))

            whole = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["th"], pa.array(n, pa.int64()), whole(d1), whole(d2), lists(sketches), lists(bands)], names=["key", "th", "n", "d1", "d2", "sketch", "bands"])
        trimmed()

    rows = docs.select(_key().alias("key"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(sign, "key long, th long, n long, d1 long, d2 long, sketch array<long>, bands array<long>")


def _near(common: np.ndarray | int, p: int, q: np.ndarray | int, per_mille: int) -> np.ndarray | bool:
    return 1000 * common >= per_mille * (p + q - common)


def _of(table: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The rows of ``table`` (cid, ...) that one side of written ``pairs`` names, before any of them is shuffled if they are few."""
    return table.join(small(pairs.select(F.col(side).alias("cid")).distinct()), "cid", "left_semi")


def verified(pairs: DataFrame, full: DataFrame, shingle_words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets reach the threshold. ``full``: (cid, text)."""
    per_mille = round(threshold * 1000)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(bodies(batch, "left"), bodies(batch, "right")):
                p, q = shingles(word_hashes(x), shingle_words), shingles(word_hashes(y), shingle_words)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(_near(common, len(p), len(q), per_mille))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(_of(full, pairs, "a").select(F.col("cid").alias("a"), F.col("text").alias("left")), "a")
    two = one.join(_of(full, pairs, "b").select(F.col("cid").alias("b"), F.col("text").alias("right")), "b")
    return two.select("a", "b", "left", "right").mapInArrow(confirm, "a long, b long")


def _near_sketches(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    of = lambda c: _of(classes, pairs, c).select(F.col("cid").alias(c), F.col("sketch").alias(f"_{c}"))
    flipped = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(of("a"), "a").join(of("b"), "b").where(flipped <= most).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("cid"))
    return members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one group, with the members ``n`` and the shingles ``load`` of the bucket."""
    mixed = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("load")).where("low <> high").select("bucket", "n", "load")
    return members.select("bucket", "cid", "label").join(mixed, "bucket")


def _pivots(members: DataFrame, used: DataFrame | None) -> DataFrame:
    """``(bucket, pivot, group)``: of each bucket the member that meets most others in all its buckets (in a group of
    near copies that is the one most alike to all), none that was a pivot before."""
    meets = members.groupBy("cid").agg(F.sum("n").alias("meets"))
    fresh = members if used is None else members.join(used, F.col("cid") == F.col("pivot"), "left_anti")
    best = fresh.join(meets, "cid").groupBy("bucket").agg(F.max(F.struct("meets", F.xxhash64("cid").alias("h"), F.col("cid").alias("pivot"), F.col("label").alias("group"))).alias("p"))
    return best.select("bucket", "p.pivot", "p.group")


def _pivot_pairs(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """One pair for each member that shares a bucket with a pivot of another group: with the pivot it meets most often."""
    met = members.join(pivots, "bucket").where("label <> group").groupBy("cid", "pivot").agg(F.count(F.lit(1)).alias("times"))
    best = met.groupBy("cid").agg(F.max(F.struct("times", "pivot")).alias("m"))
    return best.select(F.least("cid", "m.pivot").alias("a"), F.greatest("cid", "m.pivot").alias("b")).distinct()


_PLACE = ("bucket", "p", "q")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole (bucket, p, q) groups from sorted batches, with the end of each row's group."""
    held: list[pa.RecordBatch] = []

    def grouped(parts: list[pa.RecordBatch], last: bool) -> tuple[pa.Table, np.ndarray, int]:
        table = pa.Table.from_batches(parts).combine_chunks()
        changes = np.zeros(max(len(table) - 1, 0), dtype=bool)
        for c in _PLACE:
            x = table[c].to_numpy()
            changes |= x[1:] != x[:-1]
        ends = np.concatenate([np.flatnonzero(changes) + 1, [len(table)]])
        cut = len(table) if last else int(ends[-2]) if len(ends) > 1 else 0
        return table, np.repeat(ends, np.diff(ends, prepend=0)), cut

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        table, ends, cut = grouped(held, False)
        if cut:
            yield table.slice(0, cut), ends[:cut]
            held = table.slice(cut).to_batches()
    if held:
        table, ends, cut = grouped(held, True)
        yield table, ends


def _matrix(column: pa.ChunkedArray, kind: type = np.uint64) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).view(kind)  # bits of signed numbers count by their absolute value


def _near_pairs(table: pa.Table, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (left, right) of one group and of two labels whose sketches are near, left ascending.

    A pair that shares several buckets is given by the first of their bands alone, told by the low 32 bits of the bands.
    """
    bucket, p, q, block, label = (table[c].to_numpy() for c in ("bucket", "p", "q", "block", "label"))
    sketch, marks, mark = _matrix(table["sketch"]), _matrix(table["marks"], np.uint32), bucket.view(np.uint64).astype(np.uint32)
    count = ends - np.arange(len(ends)) - 1
    upto = np.cumsum(count)
    at = 0
    while at < len(ends):
        base = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + _PAIRS, side="right")))
        n = count[at:stop]
        left = np.repeat(np.arange(at, stop), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        ok = (label[left] != label[right]) & ((p[left] == q[left]) | (block[left] != block[right]))
        left, right = left[ok], right[ok]
        ok = np.bitwise_count(sketch[left] ^ sketch[right]).sum(axis=1, dtype=np.int64) <= most
        left, right = left[ok], right[ok]
        first = (marks[left] == marks[right]).argmax(axis=1)
        ok = marks[left, first] == mark[left]
        yield left[ok], right[ok]
        at = stop


def _joining(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray, per_mille: int) -> list[tuple[int, int]]:
    """Of the pairs (left, right) of one group's rows those that reach the threshold and join what was apart so far."""
    parent = {int(x): int(x) for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = np.array([len(x) for x in sets])
    begin = np.cumsum(sizes) - sizes
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(known), dtype=np.int64)
    out = []
    bounds = np.concatenate([np.flatnonzero(np.diff(left, prepend=-1)), [len(left)]])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        i = int(left[lo])
        mine = root(int(labels[i]))
        others = np.array([j for j in right[lo:hi].tolist() if root(int(labels[j])) != mine], dtype=np.int64)
        if not len(others):
            continue
        own = ids[begin[i] : begin[i] + sizes[i]]
        marked[own] = 1
        common = np.array([marked[ids[begin[j] : begin[j] + sizes[j]]].sum() for j in others])
        marked[own] = 0
        for j in others[_near(common, sizes[i], sizes[others], per_mille)].tolist():
            a, b = root(int(labels[i])), root(int(labels[j]))
            if a != b:
                parent[a] = b
                out.append((i, j))
    return out


def _block_links(members: DataFrame, classes: DataFrame, full: DataFrame, shingle_words: int, threshold: float, most: int) -> DataFrame:
    """``(a, b)``: links that join groups, found among the members of one bucket and two groups."""
    per_mille = round(threshold * 1000)
    schema = "bucket long, p int, q int, block int, cid long, label long, sketch array<long>, marks array<int>"

    def undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in _whole_groups(batches):
            hit = np.zeros(len(table), dtype=bool)
            for left, right in _near_pairs(table, ends, most):
                hit[left] = hit[right] = True
            yield from table.filter(pa.array(hit)).to_batches()

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in _whole_groups(batches):
            cid, label, texts = table["cid"].to_numpy(), table["label"].to_numpy(), table["text"].combine_chunks()
            at = 0
            while at < len(table):
                end = int(ends[at])
                group = table.slice(at, end - at)
                found = list(_near_pairs(group, ends[at:end] - at, most))
                left, right = (np.concatenate([x[i] for x in found]) for i in range(2))
                if len(left):
                    part = pa.RecordBatch.from_arrays([texts.slice(at, end - at)], names=["text"])
                    sets = [shingles(word_hashes(body), shingle_words) for body in bodies(part, "text")]
                    links = _joining(sets, label[at:end], left, right, per_mille)
                    a, b = (np.array([cid[at + x[i]] for x in links], dtype=np.int64) for i in range(2))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                at = end
        trimmed()

    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("load") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    marks = F.transform("bands", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))  # the low half
    # Few classes are still open, as a rule: their ids are written, so that the planner knows how many they are.
    open_ = written(members.select("cid").distinct(), "near-open-classes")
    looks = classes.join(open_, "cid", "left_semi").select("cid", "sketch", marks.alias("marks"))
    rows = dealt.join(looks, "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "cid", "label", "sketch", "marks")
    sorted_ = lambda df: df.repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    left = written(sorted_(rows).mapInArrow(undecided, schema), "near-undecided")
    return sorted_(left.join(full, "cid")).mapInArrow(confirmed, "a long, b long")


def _grouped(docs: DataFrame, shingle_words: int, threshold: float) -> DataFrame:
    """``(key, th, n, rep)`` of each row; ``rep``: the least (key, th) of its group, null for an empty set."""
    most = most_flipped(threshold - MARGIN)
    rows = written(signatures(docs, shingle_words), "near-signatures")
    sets = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("key", "th")).alias("rep"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = written(sets.withColumn("cid", F.xxhash64("d1", "d2", "n")), "near-classes")
    seats = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = seats.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    members = seats.join(shared, "bucket").join(classes.select("cid", F.col("n").alias("size")), "cid")
    members = written(members.select("cid", "size", "bucket"), "near-buckets")
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "rep.key", "rep.th")
    # Repeated rows fold into one before the join, so that none of its keys is hot.
    texts = docs.select(_key().alias("key"), F.xxhash64("text").alias("th"), "text").groupBy("key", "th").agg(F.first("text").alias("text"))
    full = written(texts.join(wanted, ["key", "th"]).select("cid", "text"), "near-texts")

    links, labels, used = None, None, None

    def merged(new: DataFrame) -> bool:
        nonlocal links, labels
        if new.isEmpty():
            return False
        links = new if links is None else links.union(new)
        labels = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "near-labels")
        return True

    for _ in range(PIVOT_ROUNDS):
        open_members = written(_open(_labelled(members, labels)), "near-open")
        pivots = written(_pivots(open_members, used), "near-pivots")
        used = pivots.select("pivot").distinct() if used is None else used.union(pivots.select("pivot")).distinct()
        met = written(_pivot_pairs(open_members, pivots), "near-met")
        pairs = written(_near_sketches(met, classes, most), "near-pairs")
        if not merged(written(verified(pairs, full, shingle_words, threshold), "near-links")):
            break
    open_members = written(_open(_labelled(members, labels)), "near-open")
    merged(written(_block_links(open_members, classes, full, shingle_words, threshold, most), "near-links"))

    groups = classes.select("cid", "d1", "d2", "n", "rep")
    if labels is not None:
        linked = groups.join(labels.withColumnRenamed("node", "cid"), "cid")
        least = linked.groupBy("label").agg(F.min("rep").alias("least"))
        groups = groups.join(linked.select("cid", "label").join(least, "label").select("cid", "least"), "cid", "left").withColumn("rep", F.coalesce("least", "rep"))
    # Written, so that both sides of the join are plain shuffles: rows of a set that holds many of them are then split.
    groups = written(groups.select("d1", "d2", "n", "rep"), "near-groups")
    return rows.select("key", "th", "n", "d1", "d2").join(groups, ["d1", "d2", "n"], "left").select("key", "th", "n", "rep")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row."""
    component = F.coalesce("rep.key", "key")
    shown = lambda c: F.when(c != NULL_KEY, c)
    out = _grouped(docs, shingle_words, threshold)
    return out.select(shown(F.col("key")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(component).alias("component_id"), (F.col("key") == component).alias("kept"))


def deduplicated(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but one row of each group: the one with the least doc_id (of repeated rows, any one)."""
    kept = F.col("rep").isNull() | (F.struct("key", "th") == F.col("rep"))
    verdicts = written(_grouped(docs, shingle_words, threshold).withColumn("kept", kept), "near-verdicts")
    # Nearly always an id alone decides; where rows that share one have several verdicts, or are kept twice, the text does.
    by_id = verdicts.groupBy(F.col("key").alias("_weftlink_k")).agg(F.bool_or("kept").alias("any"), F.count(F.lit(1)).alias("n"))
    gone = written(by_id.where("NOT any").select("_weftlink_k"), "near-removed")
    shared = written(by_id.where("any AND n > 1").select("_weftlink_k"), "near-shared")
    left = docs.withColumn("_weftlink_k", _key()).join(gone, "_weftlink_k", "left_anti")
    if shared.isEmpty():
        return left.drop("_weftlink_k")
    on = ["_weftlink_k", "_weftlink_t"]
    own = verdicts.join(shared, verdicts["key"] == shared["_weftlink_k"], "left_semi").select(F.col("key").alias("_weftlink_k"), F.col("th").alias("_weftlink_t"), "n", "kept")
    of_shared = left.join(shared, "_weftlink_k", "left_semi").withColumn("_weftlink_t", F.xxhash64("text"))
    of_shared = of_shared.join(own.where("NOT kept").select(*on).distinct(), on, "left_anti")
    repeated = written(own.where("kept AND n > 0").groupBy(*on).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*on), "near-repeated")
    once = of_shared.join(repeated, on, "left_semi").dropDuplicates(on)
    rest = of_shared.join(repeated, on, "left_anti")
    return left.join(shared, "_weftlink_k", "left_anti").drop("_weftlink_k").unionByName(once.unionByName(rest).drop(*on))


def contract(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle_words=4, threshold=0.8)
