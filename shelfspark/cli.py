"""Command line: lists the queries, or runs some over a data folder and writes their results."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json

from pyspark.sql import SparkSession

from shelfspark.plans.registry import QUERIES
from shelfspark.sources.files import write_report, write_stage


def known_queries() -> dict:
    """The queries of the core and, where it is installed, of the subpackage for training data."""
    name = f"{__package__}.llm"
    more = importlib.import_module(f"{name}.registry").QUERIES if importlib.util.find_spec(name) else {}
    return {**QUERIES, **more}


def main(argv: list[str] | None = None) -> int:
    queries = known_queries()
    parser = argparse.ArgumentParser(prog="shelfspark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run queries and write their results as Parquet")
    run.add_argument("names", nargs="+", choices=sorted(queries), metavar="NAME")
    run.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", required=True, help="folder of the results")
    check = sub.add_parser("validate", help="run the validation gate; fails if a check does")
    check.add_argument("--data", required=True)
    report = sub.add_parser("report", help="write a query's small result as JSON lines, Markdown or HTML")
    report.add_argument("name", choices=sorted(queries), metavar="NAME")
    report.add_argument("--data", required=True)
    report.add_argument("--out", required=True, help="file, its ending says the kind")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    spark = SparkSession.builder.appName("shelfspark").getOrCreate()
    if args.command == "report":
        write_report(queries[args.name](spark, args.data), args.out, args.name)
        return 0
    if args.command == "validate":
        rows = QUERIES["validation_checks"](spark, args.data).collect()
        for r in rows:
            print(json.dumps(r.asDict()))
        return int(not all(r.ok for r in rows))
    for name in args.names:
        print(json.dumps(write_stage(queries[name](spark, args.data), f"{args.out}/{name}", name)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
