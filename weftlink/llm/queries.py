"""The thin queries over the corpus operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, language_id, mixing, near_dups, packing, quality_classifier, quality_rules, secrets, substring_dedup, toxicity
from .common import documents
from .oracles import SQL

Query = Callable[[SparkSession, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.contract(documents(spark, sf_dir))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.contract(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.contract(documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.contract(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract(documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.contract(documents(spark, sf_dir))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.contract(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.contract(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.contract(documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.contract(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


_ALL = (
    op1_substring_dedup,
    op2_document_fingerprints,
    op3_quality_classifier,
    op4_minhash_near_dedup,
    op5_toxicity,
    op6_secret_scans,
    op7_mixing_sources,
    op8_language_id,
    op9_quality_rules,
    op10_best_fit_packing,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}
