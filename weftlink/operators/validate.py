"""Checks of records before anything else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("entity_id", "business_name", "business_address", "country")
ID_PREFIX = "^S[123]-"


def record_errors(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """``df`` with ``errors``: columns that don't exist, and an id with another prefix (an empty id is no error)."""
    absent = [F.lit(f"missing field: {c}") for c in required if c not in df.columns]
    found = list(absent)
    if "entity_id" in df.columns:
        e = F.coalesce(F.col("entity_id"), F.lit(""))
        found.append(F.when((e != "") & ~e.rlike(ID_PREFIX), F.concat(F.lit("unknown id prefix: "), e)))
    return df.withColumn("errors", F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>"))


def table_report(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """One row: rows, nulls of each required column, ids of unknown prefix."""
    have = [c for c in required if c in df.columns]
    unknown = F.count_if(F.col("entity_id").isNotNull() & (F.col("entity_id") != "") & ~F.col("entity_id").rlike(ID_PREFIX)) if "entity_id" in have else F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in have], unknown.alias("unknown_prefix"))
