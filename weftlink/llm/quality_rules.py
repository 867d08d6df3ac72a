"""Rule filter whose cutoffs are chosen by exact binomial tests on labelled documents.

Each rule compares one measure of a text with a cutoff; a grid gives every rule the same number of cutoffs, and its
levels are nested: level by level all cutoffs get stricter. In every stratum (language) the good documents among the
labelled ones tell how many of them a level would reject. Levels are tested in a fixed order, the loosest first, and
testing ends with the first one that fails: a level is certified if it and all looser ones have an exact binomial tail
P(Bin(n, risk) <= rejected) of at most ``delta`` divided by the number of strata. A fixed sequence needs no correction
for the number of its tests, Bonferroni covers the strata: with probability 1 - delta, in no stratum do the chosen
cutoffs together reject more than ``risk`` of the good documents that pass the base rule. The strictest certified
level is used; a stratum with too few labels (86 good ones at 0.05, 0.05 and four strata) has none, and there the base
rule alone decides.

Cases: a null or blank text has no words and fails the base rule; a null language is a stratum of its own;
labels that are null or missing do not count, and a document with several labels counts as good only if all
say so; repeated rows are scored and returned row by row; an empty table gives an empty result; columns that
the operator doesn't use are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import let, small, words, written

#: Measure of each rule and its cutoffs, one for each level, the strictest first. A document is rejected above the cutoff.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "exclaim_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_ratio": (0.1, 0.15, 0.2, 0.25, 0.3, 0.4),
    "mean_word_chars": (9.0, 10.0, 11.0, 12.0, 15.0, 20.0),
}
RISK, DELTA = 0.05, 0.05


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice. Windows are compared by 64-bit hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda j, d: F.coalesce(F.get(s, j)["x"] == F.get(s, j + d)["x"], F.lit(False))
            places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(j > 0, same(j, -1)).otherwise(False) | same(j, 1))
            return F.sort_array(F.transform(places, lambda j: F.get(s, j)["i"]))

        def union(p: Column) -> Column:
            steps = F.sequence(F.lit(1), F.size(p) - 1)
            return F.aggregate(steps, F.lit(3), lambda n, j: n + F.least(F.lit(3), F.get(p, j) - F.get(p, j - 1)))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, repeated), union))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, covered))


def measures(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: the base measures, ``base_failed`` and the ratios that rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id",
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("stratum"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("rep"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("sym"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).alias("bang"),
    )
    n, chars = F.col("w.n"), F.col("w.chars")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counted.select(
        "doc_id",
        "stratum",
        n.cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        F.col("sym").cast("long").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.rep").cast("long").alias("n_repeat_words"),
        ((n < 50) | (100 * F.col("w.rep") > 50 * n)).alias("base_failed"),
        ratio(F.col("sym"), chars).alias("symbol_ratio"),
        ratio(F.col("bang"), chars).alias("exclaim_ratio"),
        ratio(F.col("l.dup"), F.col("l.n")).alias("dup_line_ratio"),
        ratio(F.col("w.rep"), n).alias("repeat_ratio"),
        ratio(chars, n).alias("mean_word_chars"),
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms; 1 where k is at least the mean."""
    odds = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)
    step = lambda s, i: F.struct(
        (s["last"] + F.ln((n - i + 1) / i) + odds).alias("last"),
        (F.greatest(s["top"], s["last"] + F.ln((n - i + 1) / i) + odds)).alias("top"),
        (s["sum"] * F.exp(s["top"] - F.greatest(s["top"], s["last"] + F.ln((n - i + 1) / i) + odds)) + F.exp(s["last"] + F.ln((n - i + 1) / i) + odds - F.greatest(s["top"], s["last"] + F.ln((n - i + 1) / i) + odds))).alias("sum"),
    )
    start = F.struct(first.cast("double").alias("last"), first.cast("double").alias("top"), F.lit(1.0).alias("sum"))
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, step, lambda s: F.exp(s["top"]) * s["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def certify(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """``(stratum, n, level, <rule>: cutoff, ...)`` of every stratum with a certified level."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    levels = range(min(map(len, grid.values())))
    rejects = lambda level: functools.reduce(lambda a, b: a | b, [F.col(rule) > cuts[level] for rule, cuts in grid.items()])
    counts = measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(rejects(level)).alias(f"k{level}") for level in levels]
    )
    counts = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))  # one row a stratum
    passed = lambda level: binomial_tail(F.col("n"), F.col(f"k{level}"), risk) <= delta / F.col("strata")
    chosen = F.lit(None).cast("int")
    for level in levels:  # from the strictest to the loosest, so that the loosest is asked first
        chosen = F.when(passed(level), F.coalesce(chosen, F.lit(level)))
    held = counts.select("stratum", "n", chosen.alias("level")).where("level IS NOT NULL")
    return held.select("*", *[F.get(F.array(*[F.lit(c) for c in cuts]), F.col("level")).alias(f"cut_{rule}") for rule, cuts in grid.items()])


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """Measures of every document, the cutoffs of its stratum and ``kept``."""
    measured = written(measures(docs), "quality-measures")
    cutoffs = written(certify(measured, labels, risk, delta, grid).drop("n", "level"), "quality-cutoffs")
    above = F.lit(False)
    for rule in grid:
        above = above | F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return measured.join(small(cutoffs), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~above)


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = apply_rules(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
