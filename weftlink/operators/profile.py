"""Exact profiles of source files and of the ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .stats import discrete

# The id format and the percentiles of the reports.
ID_FORMAT = "^(S[123])-(\\p{Nd}+)$"
LENGTH_POINTS, MATCH_POINTS = (50, 90, 95, 99), (10, 25, 50, 75, 90, 95, 99, 99.9)
# Groups of match counts, with their least and greatest count.
MATCH_GROUPS = (
    ("0 matches (singletons)", 0, 0),
    ("1 match", 1, 1),
    ("2 matches", 2, 2),
    ("3 matches", 3, 3),
    ("4 matches", 4, 4),
    ("5 matches", 5, 5),
    ("6 to 10 matches", 6, 10),
    ("11 to 20 matches", 11, 20),
    ("21 to 50 matches", 21, 50),
    ("> 50 matches", 51, None),
)


def non_ascii(c: Column) -> Column:
    return F.coalesce(c.rlike("[^\\x00-\\x7F]"), F.lit(False))


def missing_profile(df: DataFrame, *columns: str) -> DataFrame:
    """``(field, total, missing, blank, valid, missing_pct)`` of each column: null or empty, and white space only."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = [F.struct(F.lit(x).alias("field"), (c(x) == "").alias("missing"), ((c(x) != "") & (F.btrim(c(x), F.lit(" \t\n\r\x0b\x0c")) == "")).alias("blank")) for x in columns]
    long = df.select(F.inline(F.array(*rows)))
    out = long.groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count_if("missing").alias("missing"), F.count_if("blank").alias("blank"))
    return out.withColumns({"valid": F.col("total") - F.col("missing") - F.col("blank"), "missing_pct": F.bround(100 * (F.col("missing") + F.col("blank")) / F.col("total"), 2)})


def id_profile(df: DataFrame, column: str = "entity_id") -> DataFrame:
    """One row: rows, exact distinct ids, repeats and ids of another format."""
    c = F.col(column)
    out = df.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(c).alias("unique_ids"), F.count(c).alias("n"), F.count_if(~c.rlike(ID_FORMAT)).alias("format_mismatches"))
    return out.select("total", "unique_ids", (F.col("n") - F.col("unique_ids")).alias("duplicates"), "format_mismatches")


def length_profile(df: DataFrame, *columns: str) -> DataFrame:
    """``(field, n, min, max, mean, p50, p90, p95, p99, non_ascii)`` of the non-empty texts of each column."""
    rows = [F.struct(F.lit(x).alias("field"), F.length(x).cast("long").alias("len"), non_ascii(F.col(x)).alias("odd"), (F.coalesce(F.col(x), F.lit("")) != "").alias("some")) for x in columns]
    long = df.select(F.inline(F.array(*rows))).where("some")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("len").alias("min"), F.max("len").alias("max"), F.bround(F.avg("len"), 4).alias("mean"), *discrete(long, "len", LENGTH_POINTS), F.count_if("odd").alias("non_ascii"))


def country_top(df: DataFrame, k: int = 10, column: str = "country") -> DataFrame:
    """The k most frequent values with their shares; ties by value."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row a value
    top = counted.where("value IS NOT NULL").orderBy(F.desc("n"), "value").limit(k)
    return top.select("value", "n", F.bround(100 * F.col("n") / F.col("total"), 2).alias("pct"))


def source_profile(df: DataFrame) -> dict[str, DataFrame]:
    """All parts of the profile of a source table."""
    return {
        "ids": id_profile(df),
        "missing": missing_profile(df, "entity_id", "business_name", "business_address", "country"),
        "lengths": length_profile(df, "business_name", "business_address"),
        "countries": country_top(df),
        "samples": df.select("entity_id").limit(5),
    }


def matches_per_record(lines: DataFrame) -> DataFrame:
    """``(s1_id, n, n_s2, n_s3)`` of each line of a ground-truth table."""
    each = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda t: F.btrim(t)), lambda t: t != "")
    rows = lines.select(F.btrim("source1_entity_id").alias("s1_id"), each.alias("m"))
    of = lambda p: F.size(F.filter("m", lambda t: t.startswith(p)))
    return rows.select("s1_id", F.size("m").cast("long").alias("n"), of("S2-").cast("long").alias("n_s2"), of("S3-").cast("long").alias("n_s3"))


def ground_truth_profile(lines: DataFrame) -> DataFrame:
    """One row of totals, co-occurrence, mean, population deviation and percentiles of matches per record."""
    per = matches_per_record(lines)
    two, three = F.col("n_s2"), F.col("n_s3")
    return per.agg(
        F.count(F.lit(1)).alias("total_s1"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"), F.coalesce(F.sum(two), F.lit(0)).alias("s2_matches"), F.coalesce(F.sum(three), F.lit(0)).alias("s3_matches"),
        F.count_if(F.col("n") == 0).alias("singletons"), F.count_if((two > 0) & (three == 0)).alias("s2_only"), F.count_if((three > 0) & (two == 0)).alias("s3_only"), F.count_if((two > 0) & (three > 0)).alias("both"),
        F.min("n").alias("min"), F.max("n").alias("max"), F.bround(F.avg("n"), 4).alias("mean"), F.bround(F.coalesce(F.stddev_pop("n"), F.lit(0.0)), 4).alias("std"), *discrete(per, "n", MATCH_POINTS),
    )


def match_groups(lines: DataFrame) -> DataFrame:
    """``(label, n, pct)`` of each group of match counts."""
    n = F.col("n")
    inside = lambda lo, hi: (n >= lo) & (F.lit(True) if hi is None else n <= hi)
    rows = [F.struct(F.lit(label).alias("label"), inside(lo, hi).alias("in")) for label, lo, hi in MATCH_GROUPS]
    long = matches_per_record(lines).select(F.inline(F.array(*rows)))
    return long.groupBy("label").agg(F.count_if("in").alias("n"), F.bround(100 * F.count_if("in") / F.count(F.lit(1)), 2).alias("pct"))


def matched_ids(lines: DataFrame) -> DataFrame:
    """``(source, matches, distinct_ids)``: the secondary ids of a ground-truth table, counted once each."""
    from .ground_truth import exploded, source_of

    ids = exploded(lines).select(source_of(F.col("secondary_id")).alias("source"), "secondary_id")
    return ids.groupBy("source").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("secondary_id").alias("distinct_ids"))


def co_occurrence(lines: DataFrame) -> DataFrame:
    """``(kind, n)``: records without matches, with matches in one source only, in both."""
    kind = F.when(F.col("n") == 0, "singleton").when((F.col("n_s2") > 0) & (F.col("n_s3") > 0), "both").when(F.col("n_s2") > 0, "s2_only").when(F.col("n_s3") > 0, "s3_only").otherwise("other")
    return matches_per_record(lines).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
