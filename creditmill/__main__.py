"""Command line: ``python -m creditmill features ...`` and ``python -m creditmill load ...``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from creditmill.config import FeatureConfig, LoadConfig
from creditmill.operators.coercion import coerce_loans
from creditmill.operators.summary import summarise, summary_counts
from creditmill.plans.feature_table import run_features
from creditmill.plans.load import chunk_counters, load_features, plan_load
from creditmill.session import build_session
from creditmill.sources.files import number_rows, read_features
from creditmill.sources.store import LoanStore


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="creditmill")
    jobs = parser.add_subparsers(dest="job", required=True)
    features = jobs.add_parser("features", help="raw loan CSV to feature table")
    features.add_argument("--input", required=True)
    features.add_argument("--output", required=True)
    features.add_argument("--version", default=FeatureConfig().version)
    features.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    load = jobs.add_parser("load", help="feature table into the stored tables")
    load.add_argument("--input", required=True)
    load.add_argument("--store", required=True, help="root folder of the stored tables")
    load.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    load.add_argument("--chunk-size", type=int, default=None, help="also report per chunk")
    load.add_argument("--source-split", default=LoadConfig().source_split)
    load.add_argument("--strict", action="store_true")
    load.add_argument("--dry-run", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session()
    if args.job == "features":
        config = replace(FeatureConfig(), version=args.version)
        table = run_features(spark, args.input, args.output, config, args.format)
        summarise(table).show(truncate=False)
        summary_counts(table).show(truncate=False)
        return
    config = LoadConfig(source_split=args.source_split, strict=args.strict, dry_run=args.dry_run)
    rows = read_features(spark, args.input, args.format, with_order=True)
    store = LoanStore(spark, args.store)
    if args.chunk_size:
        coerced = coerce_loans(number_rows(rows), config)
        plan = plan_load(coerced, store.read("loan_applicants"))
        chunk_counters(plan, args.chunk_size).orderBy("chunk_no").show(truncate=False)
    print(load_features(rows, store, config))


if __name__ == "__main__":
    main()
