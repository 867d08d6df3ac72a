"""Pieces that several corpus operators share: shared scratch tables, word splitting, order helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.scratch import written

#: Fixed value: words are runs of anything but these six white-space characters.
WORD_BREAK = r"[\x20\x09-\x0D]+"
_BREAK_CHARS = " \t\n\x0b\x0c\r"
#: Stands for a null id where a join or an order needs a key.
NULL_KEY = -(2**63)
#: Tables of at most so many rows may be broadcast (they are counted first).
BROADCAST_ROWS = 10_000


#: Places that running totals take together.
_RUN = 128
#: Rows and bytes of a batch that goes to Python: texts are long, and a worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small (settings of the session, lowered only)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array of numbers from 0 on, by a sum or a maximum: total i covers places 0 to i.

    Blocks of ``_RUN`` places are totalled first, then their totals; a place adds what its own block has before it. So
    the work is in proportion to the size (up to ``_RUN`` cubed places), and no array is copied once a place.
    """
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: op(a, b))

    def totals(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _RUN).cast("int")), lambda k: total(F.slice(s, k * _RUN + 1, _RUN)))
        ahead = let(blocks, lambda b: F.transform(b, lambda _, k: total(F.slice(b, F.lit(1), k))))
        block = lambda i: F.floor(i / _RUN).cast("int")
        return F.when(F.size(s) < 2, s).otherwise(let(ahead, lambda a: F.transform(s, lambda _, i: op(F.get(a, block(i)), total(F.slice(s, block(i) * _RUN + 1, i % _RUN + 1))))))

    return let(values, totals)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BREAK_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows that it is small; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def range_parts(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` in range partitions of ``order`` with the partition number as ``part``, fixed by writing it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")


def following(ids: DataFrame, key: str) -> DataFrame:
    """For distinct non-null keys: ``(key, next_key, prev_key)`` in descending order, as a ring.

    Keys are range partitioned; neighbours come from a window inside each range, and only one row a
    range (its ends) meets in a single task.
    """
    parts = range_parts(ids.select(key).distinct(), key)
    ends = parts.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    every = Window.orderBy(F.desc("part"))
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("high").over(every), F.first("high").over(whole)).alias("below"),
        F.coalesce(F.lag("low").over(every), F.last("low").over(whole)).alias("above"),
    )
    inside = Window.partitionBy("part").orderBy(F.desc(key))
    return parts.join(F.broadcast(ends), "part").select(
        key,
        F.coalesce(F.lead(key).over(inside), F.col("below")).alias("next_key"),
        F.coalesce(F.lag(key).over(inside), F.col("above")).alias("prev_key"),
    )


def running_offset(df: DataFrame, group: str, order: str, size: str, out: str) -> DataFrame:
    """Sum of ``size`` over the rows before each row of its group, in ``order``.

    A group may hold most rows: the table is range partitioned by (group, order), each range is summed
    by a window of its own, and only the sums of (group, range) meet in one task of a group.
    """
    parts = range_parts(df, group, order)
    sums = parts.groupBy(group, "part").agg(F.sum(size).alias("_sum"))
    ahead = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    here = Window.partitionBy(group, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn(out, F.coalesce(F.sum(size).over(here), F.lit(0)))
    return inside.join(sums, [group, "part"]).withColumn(out, F.col(out) + F.col("_base")).drop("_base", "part")
