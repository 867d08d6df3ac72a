"""Reading a baseline report and its sample back, and a summary of both."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import write_text
from .report import _line, _section

# Texts that count as true.
TRUE_TEXTS = ("true", "1", "yes")


def to_bool(column: Column | str) -> Column:
    """Whether a text says true; missing texts don't."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_TEXTS), F.lit(False))


def to_float(column: Column | str) -> Column:
    """The number a text holds, null for anything else."""
    c = F.col(column) if isinstance(column, str) else column
    return F.trim(c).try_cast("double")


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """A written sample of true matches: flags as booleans, similarities as numbers, everything else as text."""
    df = spark.read.option("header", True).csv(path)
    number = lambda c: c.endswith(("_jw", "_sim")) or c == "combined"
    flag = lambda c: c.startswith(("exact_", "same_", "similar_")) or c.endswith(("_missing", "_equal"))
    return df.select(*[to_float(c).alias(c) if number(c) else to_bool(c).alias(c) if flag(c) else F.col(c) for c in df.columns])


def _value(text: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(text.replace(",", ""))
        except ValueError:
            pass
    return text


def parse_report(text: str) -> dict[str, dict | list[dict] | list[str]]:
    """The sections of a written report: label and value lines as a dict, tables as a list of rows, prose as lines."""
    lines, out = text.split("\n"), {}
    heads = [i for i in range(len(lines) - 1) if lines[i] and set(lines[i + 1]) == {"-"} and len(lines[i]) == len(lines[i + 1])]
    for at, end in zip(heads, [*heads[1:], len(lines)]):
        body = [x for x in lines[at + 2 : end] if x.strip()]
        if not body:
            out[lines[at]] = {}
        elif all(re.fullmatch(r"  \S.{38,}\s\S.*", x) and len(re.split(r"\s{2,}|(?<=^.{42})\s", x.strip())) == 2 for x in body):
            out[lines[at]] = {k: _value(v) for k, v in (re.split(r"\s+(?=\S+$)", x.strip()) for x in body)}
        elif not body[0].startswith(" "):
            columns = [(m.start(), m[0]) for m in re.finditer(r"\S+", body[0])]
            edges = [*[s for s, _ in columns[1:]], None]
            out[lines[at]] = [{name: _value(row[start:stop].strip()) for (start, name), stop in zip(columns, edges)} for row in body[1:]]
        else:
            out[lines[at]] = [x.strip() for x in body]
    return out


def sample_summary(sample: DataFrame) -> DataFrame:
    """One row: the rows, the share of every flag and the mean of every number."""
    shares = [F.avg(F.col(c).cast("int")).alias(c) for c, kind in sample.dtypes if kind == "boolean"]
    means = [F.avg(c).alias(c) for c, kind in sample.dtypes if kind == "double"]
    return sample.agg(F.count(F.lit(1)).alias("n"), *shares, *means)


def failure_patterns(rules: list[dict], sample: dict) -> list[str]:
    """What makes the rules fail, in words: which error dominates, which gaps between rules, which kinds of matches."""
    out = []
    overall = [r for r in rules if r.get("source") == "Overall"]
    for r in overall:
        worse = "precision" if r["precision"] < r["recall"] else "recall"
        what = "proposes more wrong pairs than it misses right ones" if r["fp"] > r["fn"] else "misses more right pairs than it proposes wrong ones"
        out.append(f"{r['rule']} {what} ({r['fp']:,} against {r['fn']:,}); its weaker side is {worse} ({r[worse]:.4f}).")
    if len(overall) > 1:
        low, high = (f(overall, key=lambda r: r["recall"]) for f in (min, max))
        out.append(f"Recall goes from {low['recall']:.4f} ({low['rule']}) to {high['recall']:.4f} ({high['rule']}).")
    by_source = [r for r in rules if r.get("source") not in (None, "Overall")]
    for name in dict.fromkeys(r["rule"] for r in by_source):
        mine = sorted((r for r in by_source if r["rule"] == name), key=lambda r: r["f1"])
        if len(mine) > 1 and mine[-1]["f1"] > mine[0]["f1"]:
            out.append(f"{name} does worse on {mine[0]['source']} (F1 {mine[0]['f1']:.4f}) than on {mine[-1]['source']} ({mine[-1]['f1']:.4f}).")
    for key, words in (("exact_raw", "have equal raw names"), ("exact_norm", "have equal normalised names"), ("addr_missing", "lack the secondary address"), ("similar_format", "have similar names in another format")):
        if isinstance(sample.get(key), (int, float)):
            out.append(f"{100 * sample[key]:.2f}% of the sampled matches {words}.")
    return out


def summarise(spark: SparkSession, report_text: str, sample_path: str | None = None, path: str | None = None) -> str:
    """Summary of a written report and, if there is one, its sample; written to ``path`` if that is given."""
    found = parse_report(report_text)
    rules = found.get("Rules against the ground truth", [])
    sample = dict(found.get("Sample of true matches", {}))
    out = ["Summary of the baseline"]
    if sample_path:
        sample |= {k: v for k, v in sample_summary(read_sample(spark, sample_path)).first().asDict().items() if v is not None}
    out += _section("Sample") + [_line(k, v) for k, v in sample.items()]
    out += _section("Rules") + [_line(f"{r['rule']} ({r['source']})", f"P {r['precision']:.4f}  R {r['recall']:.4f}  F1 {r['f1']:.4f}") for r in rules]
    out += _section("Failure patterns") + [f"  {x}" for x in failure_patterns(rules, sample)]
    text = "\n".join(out) + "\n"
    return write_text(text, path) if path else text
