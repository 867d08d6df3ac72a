"""Evaluation of scores against labels: confusion counts, precision, recall, F-beta, and threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# 0.05, 0.10, ... 0.95.
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
METRICS = ("threshold", "precision", "recall", "f1", "f_beta", "tp", "fp", "fn", "tn", "n_predicted_positive", "n_actual_positive", "support")


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    return ratio((1 + beta * beta) * p * r, beta * beta * p + r)


def with_metrics(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """``counts`` (tp, fp, fn) with unrounded precision, recall, f1 and f_beta."""
    df = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumns({"f1": f_beta(p, r), "f_beta": f_beta(p, r, beta)})


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row ``tp, fp, fn, tn`` of ``(label, score)``; a score at the threshold is positive, and rows with a label
    other than 0 and 1 count as tn."""
    hit, label = F.coalesce(F.col("score") >= threshold, F.lit(False)), F.col("label")
    one = lambda cond: F.count_if(cond)
    out = scored.agg(one((label == 1) & hit).alias("tp"), one((label == 0) & hit).alias("fp"), one((label == 1) & ~hit).alias("fn"), F.count(F.lit(1)).alias("n"))
    return out.select("tp", "fp", "fn", (F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def _rounded(df: DataFrame) -> DataFrame:
    df = df.withColumns({"n_predicted_positive": F.col("tp") + F.col("fp"), "n_actual_positive": F.col("tp") + F.col("fn"), "support": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")})
    return df.withColumns({c: F.bround(c, 6) for c in ("precision", "recall", "f1", "f_beta")}).select(*METRICS)


def at_threshold(scored: DataFrame, threshold: float = 0.5, beta: float = 1.0) -> DataFrame:
    """The metric row at one threshold."""
    return _rounded(with_metrics(confusion(scored, threshold).withColumn("threshold", F.lit(float(threshold))), beta))


def sweep(scored: DataFrame, thresholds: Sequence[float] | None = None, beta: float = 1.0) -> DataFrame:
    """A metric row for each threshold, ascending. One pass: scores fall into the bins between thresholds, whose counts
    are added up from above."""
    cuts = sorted({float(t) for t in (THRESHOLDS if thresholds is None else thresholds)})
    at = F.lit(0)
    for t in cuts:
        at = at + F.coalesce(F.col("score") >= t, F.lit(False)).cast("int")
    label = F.col("label")
    bins = scored.select(at.alias("bin"), "label").groupBy("bin").agg(F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg"), F.count(F.lit(1)).alias("n"))
    spark = scored.sparkSession
    grid = spark.createDataFrame([(i, cuts[i - 1] if i else None) for i in range(len(cuts) + 1)], "bin int, threshold double")
    table = grid.join(bins, "bin", "left").fillna(0, ["pos", "neg", "n"])  # a row a threshold
    above = Window.orderBy(F.desc("bin"))
    every = Window.partitionBy()
    table = table.select(
        "threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(every).alias("all_pos"), F.sum("n").over(every).alias("all"),
    ).where("threshold IS NOT NULL")
    counts = table.select("threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all") - F.col("all_pos") - F.col("fp")).alias("tn"))
    return _rounded(with_metrics(counts, beta)).orderBy("threshold")


def check_lengths(labels: Sequence, scores: Sequence) -> None:
    if len(labels) != len(scores):
        raise ValueError(f"{len(labels)} labels but {len(scores)} scores")
