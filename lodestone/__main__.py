"""Command line: ``python -m lodestone list | run QUERY DIR | health FILE | updates FILE``.

``run`` prints JSON lines; ``health`` ends with 1 if a case is broken, ``updates`` with 2 if a check failed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _positive(most: int):
    def parse(text: str) -> int:
        value = int(text)
        if not 1 <= value <= most:
            raise argparse.ArgumentTypeError(f"1 to {most}")
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestone", description=__doc__.splitlines()[0])
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="a query over a folder of tables, as JSON lines")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--rows", type=_positive(1_000_000), default=100, help="rows printed at the most")
    health = commands.add_parser("health", help="counts of health states of observed cases (JSON lines)")
    health.add_argument("cases")
    checks = commands.add_parser("updates", help="statuses of update checks (JSON lines with the columns of update_status)")
    checks.add_argument("checks")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    from lodestone.plans import catalog, sessions

    if args.command == "list":
        print("\n".join(sorted(sessions.QUERIES)))
        return 0
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    if args.command == "run":
        if args.query not in catalog.QUERIES:
            print(f"no query {args.query!r}", file=sys.stderr)
            return 2
        for line in catalog.QUERIES[args.query](spark, args.tables).limit(args.rows).toJSON().collect():
            print(line)
        return 0
    if args.command == "health":
        from lodestone.functions import helpers

        counts = spark.read.json(args.cases).groupBy("state").agg(F.count("*").alias("n"))
        for row in counts.orderBy("state").collect():
            print(f"{row['state']}\t{row['n']}")
        return helpers.health_exit_code(counts)
    from lodestone.streaming import updates

    checks = spark.read.schema(updates.CHECKS).json(args.checks)
    found = updates.update_status(checks).groupBy("status").agg(F.count("*").alias("n"), F.max(updates.exit_code(F.col("status"))).alias("code")).orderBy("status").collect()
    for row in found:
        print(f"{row['status']}\t{row['n']}")
    return max((row["code"] for row in found), default=0)


if __name__ == "__main__":
    sys.exit(main())
