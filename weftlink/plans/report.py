"""Text reports from small collected tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row


def _section(title: str) -> list[str]:
    return ["", title, "-" * len(title)]


def _line(label: str, value: object) -> str:
    shown = f"{value:,}" if isinstance(value, int) else f"{value:.4f}" if isinstance(value, float) else str(value)
    return f"  {label:<40} {shown}"


def row_lines(row: Row) -> list[str]:
    return [_line(k, v) for k, v in row.asDict().items()]


def table_lines(df: DataFrame, most: int = 1000) -> list[str]:
    """A small table, columns aligned."""
    rows = df.limit(most).collect()
    cells = [list(df.columns)] + [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells]


def threshold_table(rows: Sequence[dict]) -> str:
    """Fixed-width metric table, a line a threshold."""
    names = ("threshold", "precision", "recall", "f1", "tp", "fp", "fn", "tn")
    head = " ".join(f"{n:>10}" for n in names)
    body = [" ".join(f"{r[n]:>10.4f}" if isinstance(r[n], float) else f"{r[n]:>10d}" for n in names) for r in rows]
    return "\n".join([head, "-" * len(head), *body])


def training_summary(stats: Row, splits: Sequence[Row], shards: Sequence[Row], audit: dict) -> str:
    out = ["Training pairs"]
    out += _section("Pairs") + row_lines(stats)
    out += _section("Splits") + [_line(r["split"], f"{r['n_s1']:,} records, {r['n_pairs']:,} pairs") for r in sorted(splits, key=lambda r: r["split"])]
    out += _section("Shards") + [_line(f"{r['split']} {r['shard']:03d}", r["rows"]) for r in sorted(shards, key=lambda r: (r["split"], r["shard"]))]
    out += _section("Audit") + [_line("status", audit["status"]), _line("raw data", audit["raw_data_check"])]
    return "\n".join(out) + "\n"


def pilot_lines(distinct: dict, skipped: dict) -> str:
    out = _section("Records of the pilot") + [_line(f"distinct {k}", v) for k, v in distinct.items()]
    return "\n".join(out + [_line(f"matches without a record, {k}", v) for k, v in skipped.items()]) + "\n"


def baseline_report(volumes: DataFrame, rules: DataFrame, rates: DataFrame, distributions: dict[str, DataFrame], brackets: DataFrame, disagreements: DataFrame) -> str:
    out = ["Baseline analysis"]
    out += _section("Candidate volumes") + table_lines(volumes.orderBy("pairs", ascending=False))
    out += _section("Rules against the ground truth") + table_lines(rules.orderBy("rule", "source"))
    out += _section("Sample of true matches") + row_lines(rates.first())
    for name, df in distributions.items():
        out += _section(f"Distribution of {name}") + [x for r in df.collect() for x in row_lines(r)]
    out += _section("Brackets") + table_lines(brackets.orderBy("field", "bracket"))
    out += _section("Disagreements") + row_lines(disagreements.first())
    out += findings(rules, rates)
    return "\n".join(out) + "\n"


def findings(rules: DataFrame, rates: DataFrame) -> list[str]:
    """What the figures say in words."""
    r = rates.first()
    best = rules.where("source = 'Overall'").orderBy("f1", ascending=False).first()
    out = _section("Findings")
    if best is not None:
        out.append(f"  The best rule overall is {best['rule']} (F1 {best['f1']:.4f}, precision {best['precision']:.4f}, recall {best['recall']:.4f}).")
    out.append(f"  {100 * (1 - r['exact_norm']):.2f}% of the sampled matches differ in their normalised names, so equality of names misses them.")
    if r["addr_missing"] > 0:
        out.append(f"  {100 * r['addr_missing']:.2f}% of the sampled matches lack the secondary address, so an address rule needs a way round it.")
    return out


def profile_report(name: str, parts: dict[str, DataFrame]) -> str:
    out = [f"Profile of {name}"]
    for title, df in parts.items():
        out += _section(title) + table_lines(df)
    return "\n".join(out) + "\n"
