"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none is a local one made (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftlink-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    """The folder of this application's tables: others may share the root."""
    return f"{scratch_root(spark)}/weftlink/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back: lineage ends there."""
    spark, path, schema = df.sparkSession, scratch_path(df.sparkSession, label), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows that it is small; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables (results that were not written elsewhere become unreadable)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
