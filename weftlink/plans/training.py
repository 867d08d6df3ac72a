"""The training-pair pipeline: normalise, block, label, sample, featurise, split, audit, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Weights
from ..functions.text import normalized
from ..operators import audit as audits
from ..operators import features, pairs, splits
from ..operators.blocking import BROADCAST_IDS, PREFIX_LEN
from ..operators.ground_truth import edges as edges_of
from ..operators.ground_truth import restricted
from ..schema import SHARD_COLUMNS
from ..sources import readers, writers
from ..sources.scratch import small, written
from . import report


@dataclass(frozen=True)
class Settings:
    train: float = 0.70
    val: float = 0.15
    holdout: float = 0.15
    neg_ratio: float | str = 2.0
    seed: int | None = 42
    shard_size: int = 50_000
    file_format: str = "auto"
    singletons: bool = True
    weights: Weights = Weights()


def feature_rows(pairs_: DataFrame, s1: DataFrame, sources: dict[str, DataFrame], weights: Weights = Weights()) -> DataFrame:
    """Labelled pairs with all shard columns (and whatever else they carry)."""
    every = None
    for source, records in sources.items():
        part = pairs.one_record_each(records).withColumn("_source", F.lit(source))
        every = part if every is None else every.unionByName(part)
    return features.chosen_features(pairs_, s1, every, weights)


def training_rows(s1: DataFrame, sources: dict[str, DataFrame], edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Feature rows with ``split`` and ``difficulty`` from raw records."""
    # Normalised records and chosen pairs are used by many joins: each is made once, in the shared folder.
    left = written(pairs.one_record_each(normalized(s1)), "s1")
    right = {k: written(pairs.one_record_each(normalized(v)), "secondary") for k, v in sources.items()}
    labelled = written(pairs.labelled_pairs(left, right, edges, settings.neg_ratio, settings.seed, settings.singletons), "pairs")
    split = splits.grouped_split(left.select(F.col("entity_id").alias("s1_id")), settings.train, settings.val, settings.holdout, settings.seed or 0)
    return feature_rows(splits.with_split(labelled, small(written(split, "split"), BROADCAST_IDS)), left, right, settings.weights)


def run(s1: DataFrame, sources: dict[str, DataFrame], edges: DataFrame, output_dir: str, summary_path: str | None = None, settings: Settings = Settings(), raw_before: dict[str, str] | None = None, raw_after: dict[str, str] | None = None) -> dict:
    """Write audited shards; returns statistics, the audit's report and the shards' row counts."""
    splits.check_ratios(settings.train, settings.val, settings.holdout)
    if settings.file_format not in writers.FORMATS:
        raise ValueError(f"unknown format {settings.file_format!r}")
    rows = written(training_rows(s1, sources, edges, settings), "features")  # a lost executor loses none of them
    found = audits.audit(rows, edges, raw_before, raw_after)
    if (bad := audits.cross_country(rows).first()) is not None:
        raise ValueError(f"Cross-country pair: {bad['s1_id']}, {bad['secondary_id']}")
    shards = writers.write_shards(rows, output_dir, settings.shard_size, settings.file_format, SHARD_COLUMNS).collect()  # a row a shard
    stats = pairs.pair_stats(rows).first()
    counts = audits.split_counts(rows).collect()  # a row a split
    text = report.training_summary(stats, counts, shards, found)
    if summary_path:
        writers.write_text(text, summary_path)
    return {"stats": stats.asDict(), "audit": found, "shards": [r.asDict() for r in shards], "summary": text}


def pilot(s1: DataFrame, sources: dict[str, DataFrame], ground_truth: DataFrame, output_dir: str, summary_path: str | None = None, n_s1: int = 50_000, settings: Settings = Settings(neg_ratio=1.0, singletons=False, file_format="csv")) -> dict:
    """The pipeline on the first S1 records and the secondary records that can matter to them."""
    first = readers.head(s1, n_s1)
    ids = first.select(F.col("entity_id").alias("s1_id"))
    edges = edges_of(restricted(ground_truth, ids))
    left = normalized(first)
    kept = {}
    for source, records in sources.items():
        of = edges.where(F.col("source") == source)
        kept[source] = written(pairs.prefiltered(left, normalized(records), of).select(*records.columns), "prefiltered")
    out = run(first, kept, edges, output_dir, None, settings)
    out["skipped"] = {source: pairs.skipped(left, records, edges, source).count() for source, records in kept.items()}
    out["distinct"] = distinct_counts(left).first().asDict()
    out["summary"] += report.pilot_lines(out["distinct"], out["skipped"])
    if summary_path:
        writers.write_text(out["summary"], summary_path)
    return out


def distinct_counts(records: DataFrame, prefix_len: int = PREFIX_LEN) -> DataFrame:
    """One row: the ids, normalised names, prefixes of names and countries of normalised records."""
    prefix = F.when(F.length("name_norm") >= prefix_len, F.substring("name_norm", 1, prefix_len))
    of = lambda c: F.countDistinct(c)
    return records.agg(of("entity_id").alias("ids"), of("name_norm").alias("names"), of(prefix).alias("prefixes"), of("country_norm").alias("countries"))
