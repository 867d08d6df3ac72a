"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its lower-case words with their counts. For sample k a term with weight S draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of (term, k), quantises its weight as t = floor(ln S / r + b), and
races with ln a = ln c - r (t - b + 1); the smallest a wins. Two texts have the same winner with the probability of
their generalised Jaccard similarity (sum of least over sum of largest counts), so the share of equal samples
estimates it. A winner is known by its a, of which 32 hashed bits are kept: a fingerprint is ``samples`` times
eight hex digits.

Cases: a null text is empty; a text without words has the all-zero fingerprint, equal only to others of its kind;
in the descending order of doc_id a null id comes last; rows that share a doc_id have the same next document, the
next smaller id, and if several rows have that id, the first of them in the table counts; repeated rows are returned as
often as they occur; a lone document is its own next; an empty table gives an empty result; columns that the
operator doesn't use are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, following, words, written

SAMPLES = 32
_BITS = 21
_UNIT = float(1 << _BITS)


def _uniform(h: Column, place: int) -> Column:
    """The place-th run of 21 bits of a 64-bit hash, as a number inside (0, 1)."""
    return (F.shiftrightunsigned(h, place * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)) + 0.5) / _UNIT


def _races(term: Column, log_weights: list[Column], sample: int) -> list[Column]:
    """ln a of a term in one sample for each of several weights (null where the weight is)."""
    h, g = F.xxhash64(term, F.lit(2 * sample)), F.xxhash64(term, F.lit(2 * sample + 1))
    r = -F.ln(_uniform(h, 0) * _uniform(h, 1))
    log_c = F.ln(-F.ln(_uniform(g, 0) * _uniform(g, 1)))
    b = _uniform(h, 2)
    return [log_c - r * (F.floor(w / r + b) - b + 1.0) for w in log_weights]


def signatures(counts: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """From rows (keys, term, weight columns): per key an array of 32-bit samples for each weight column.

    Zero weights take no part. The winner of each sample is a plain minimum, so partial aggregation applies.
    """
    logs = [F.when(F.col(w) > 0, F.ln(F.col(w).cast("double"))) for w in weights]
    mins = [F.min(x).alias(f"_{w}{k}") for k in range(samples) for w, x in zip(weights, _races(F.col("term"), logs, k))]
    least = counts.groupBy(*keys).agg(*mins)
    low = F.lit((1 << 32) - 1)
    each = [F.array(*[F.when(F.col(f"_{w}{k}").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(f"_{w}{k}").bitwiseAND(low)) for k in range(samples)]).alias(w) for w in weights]
    return least.select(*keys, *each)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples, an estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / float(samples)


def _terms(m: DataFrame, keys: list[str], text: Column, o: int, e: int) -> DataFrame:
    return m.select(*keys, F.explode(words(F.lower(text))).alias("w")).select(*keys, F.xxhash64("w").alias("term"), F.lit(o).alias("o"), F.lit(e).alias("e"))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, fingerprint, signature)`` of every row."""
    # Rows get their numbers once, in a written table: a second evaluation may number them otherwise.
    rows = written(docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.coalesce("text", F.lit("")).alias("text")), "fingerprint-rows")
    terms = rows.select("_row", F.explode(words(F.lower(F.col("text")))).alias("w")).select("_row", F.xxhash64("w").alias("term"))
    sig = signatures(terms.groupBy("_row", "term").agg(F.count(F.lit(1)).alias("signature")), ["_row"], ["signature"], samples)
    empty = F.array_repeat(F.lit(0).cast("long"), samples)
    out = rows.select("_row", "doc_id").join(sig, "_row", "left").withColumn("signature", F.coalesce("signature", empty))
    return out.select("doc_id", as_text(F.col("signature")).alias("fingerprint"), "signature")


def contract(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text (the tail replaced from the next document)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id"), F.lit(NULL_KEY)).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sizes = rows.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    ring = following(sizes, "key")
    need = sizes.select(F.col("key").alias("prev_key"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    ring = written(ring.join(need, "prev_key"), "fingerprint-ring")  # (key, next_key, prev_key, need)
    # The text is shuffled once, by key (both uses read the same columns, so the exchange is reused); what the previous
    # document needs of it is sent on to that one.
    placed = rows.join(ring, "key")
    heads = placed.groupBy(F.col("prev_key").alias("key")).agg(F.min_by(F.expr("substring(text, 1, need)"), "row").alias("head"))
    n, tail = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    m = placed.select("key", "row", "next_key", "text").join(heads, "key").select(
        "key", "row", "next_key", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("head"), F.lit(1), tail)).alias("edited"), (n - tail).alias("common"),
    )
    # Words that end before the cut belong to both texts and are counted together.
    shared = F.regexp_extract(F.substring(F.col("text"), F.lit(1), F.col("common")), r"(?s)^.*[\x20\x09-\x0D]", 0)
    split = m.select("key", "row", "text", "edited", F.length(shared).alias("at"), shared.alias("shared"))
    rest = lambda c: F.expr(f"substring({c}, at + 1)")
    parts = split.select(
        "key", "row",
        F.inline(F.array(F.struct(F.col("shared").alias("t"), F.lit(1).alias("o"), F.lit(1).alias("e")), F.struct(rest("text").alias("t"), F.lit(1).alias("o"), F.lit(0).alias("e")), F.struct(rest("edited").alias("t"), F.lit(0).alias("o"), F.lit(1).alias("e")))),
    )
    terms = parts.select("key", "row", "o", "e", F.explode(words(F.lower(F.col("t")))).alias("w")).select("key", "row", "o", "e", F.xxhash64("w").alias("term"))
    counts = terms.groupBy("key", "row", "term").agg(F.sum("o").alias("o"), F.sum("e").alias("e"))
    sig = signatures(counts, ["key", "row"], ["o", "e"], samples)
    zero = F.array_repeat(F.lit(0).cast("long"), samples)
    facts = m.select("key", "row", "next_key", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    both = facts.join(sig, ["key", "row"], "left").withColumns({c: F.coalesce(c, zero) for c in ("o", "e")})
    both = written(both, "fingerprints")
    after = both.groupBy(F.col("key").alias("next_key")).agg(F.min_by("o", "row").alias("after"))
    return both.join(after, "next_key", "left").select(
        F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("o")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("o"), F.col("e"), samples).alias("near_edited"), likeness(F.col("o"), F.col("after"), samples).alias("near_next"),
    )
