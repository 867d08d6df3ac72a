"""Command line: ``python -m weftlink profile|baseline|train|pilot|summary``, on files that Spark can open."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators.ground_truth import edges
from .plans import baseline, summary, training
from .sources import files, readers


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="weftlink", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=text)
        own.add_argument("--data", help="folder of the training files (else the environment or the usual folders)")
        for x in ("s1", "s2", "s3", "truth"):
            own.add_argument(f"--{x}", help="path of this table, in place of the folder's")
        own.add_argument("--out", required=True, help="output folder, or the file of a report")
        return own

    command("profile", "profiles of all tables")
    own = command("baseline", "rules against the ground truth, a sample of matches and a report")
    own.add_argument("--threshold", type=float, default=0.60)
    for name, text in (("train", "labelled pairs with features, audited, as shards"), ("pilot", "the same on the first records")):
        own = command(name, text)
        own.add_argument("--ratio", default="2.0" if name == "train" else "1.0", help="negatives for each positive, a number or p:n")
        own.add_argument("--seed", type=int, default=42)
        own.add_argument("--shard-size", type=int, default=50_000)
        own.add_argument("--format", default="auto" if name == "train" else "csv")
        own.add_argument("--summary", help="file of the summary")
        own.add_argument("--no-singletons", action="store_true", default=name == "pilot")
        if name == "pilot":
            own.add_argument("--records", type=int, default=50_000)
    own = commands.add_parser("summary", help="summary of a written baseline report and its sample")
    own.add_argument("--report", required=True)
    own.add_argument("--sample")
    own.add_argument("--out")
    return parser


def _tables(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    given = {"train_s1": args.s1, "train_s2": args.s2, "train_s3": args.s3, "train_gt": args.truth}
    if any(v is None for v in given.values()):
        given = {k: given[k] or str(v) for k, v in files.resolve_dataset(args.data).items()}
    records = [readers.read_records(spark, given[k]) for k in ("train_s1", "train_s2", "train_s3")]
    return records[0], {"S2": records[1], "S3": records[2]}, readers.read_ground_truth(spark, given["train_gt"])


def main(argv: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftlink").getOrCreate()
    if args.command == "summary":
        with open(args.report, encoding="utf-8") as f:
            print(summary.summarise(spark, f.read(), args.sample, args.out))
        return 0
    s1, sources, truth = _tables(spark, args)
    if args.command == "profile":
        print(baseline.profile_all({"S1": s1, **sources}, truth, args.out))
    elif args.command == "baseline":
        print(baseline.run(s1, sources, truth, (args.out,), args.threshold)["report"])
    else:
        settings = training.Settings(neg_ratio=args.ratio, seed=args.seed, shard_size=args.shard_size, file_format=args.format, singletons=not args.no_singletons)
        if args.command == "train":
            out = training.run(s1, sources, edges(truth), args.out, args.summary, settings)
        else:
            out = training.pilot(s1, sources, truth, args.out, args.summary, args.records, settings)
        print(out["summary"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
