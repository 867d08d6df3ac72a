"""Baseline investigation and profiling, as tables and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import normalized
from ..operators import pairs, profile, rules, stats
from ..operators.features import joined_records
from ..operators.ground_truth import edges as edges_of
from ..sources import writers
from . import report


def match_sample(s1: DataFrame, sources: dict[str, DataFrame], edges: DataFrame, k: int = 5000, seed: int = 42) -> DataFrame:
    """Similarities of a sample of true matches (normalised records)."""
    every = None
    for records in sources.values():
        every = records if every is None else every.unionByName(records)
    sample = pairs.true_match_sample(edges, k, seed)
    return rules.sample_features(joined_records(sample, pairs.one_record_each(s1), pairs.one_record_each(every)))


def run(s1: DataFrame, sources: dict[str, DataFrame], ground_truth: DataFrame, output_dirs: tuple[str, ...] = (), threshold: float = rules.ADDRESS_THRESHOLD) -> dict:
    """Candidate volumes, rule scores and sample statistics; writes the sample and a report where asked."""
    left, right, edges = normalized(s1), {k: normalized(v) for k, v in sources.items()}, edges_of(ground_truth)
    volumes = rules.candidate_volumes(left, right)
    scored = rules.rule_counts(left, right, edges, threshold=threshold)
    sample = match_sample(left, right, edges)
    rates = rules.sample_rates(sample)
    spread = {c: stats.linear(sample, c) for c in ("name_jw", "combined")} | {"addr_jw (present)": stats.linear(sample.where("NOT addr_missing"), "addr_jw")}
    text = report.baseline_report(volumes, scored, rates, spread, rules.brackets(sample), rules.disagreements(sample))
    for d in output_dirs:
        writers.write_table(sample, f"{d}/true_match_sample")
        writers.write_text(text, f"{d}/baseline_analysis.txt")
    return {"volumes": volumes, "rules": scored, "sample": sample, "rates": rates, "report": text}


def profile_all(tables: dict[str, DataFrame], ground_truth: DataFrame | None = None, path: str | None = None, malformed: dict[str, DataFrame] | None = None) -> str:
    """Profiles of source tables and the ground truth as one text. ``malformed``: see ``readers.malformed_counts``."""
    bad = lambda name: {"lines": malformed[name]} if malformed and name in malformed else {}
    parts = [report.profile_report(name, bad(name) | profile.source_profile(df)) for name, df in tables.items()]
    if ground_truth is not None:
        parts.append(report.profile_report("ground truth", {"totals": profile.ground_truth_profile(ground_truth), "kinds": profile.co_occurrence(ground_truth), "matches": profile.match_groups(ground_truth), "matched ids": profile.matched_ids(ground_truth)}))
    text = "\n".join(parts)
    return writers.write_text(text, path) if path else text
