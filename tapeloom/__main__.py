"""python -m tapeloom: query, validate, tasks, trace, study, report, synth. Exit code 0: well; 1: found something; 2: misused."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tapeloom")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("query", help="show a registered query's first rows")
    p.add_argument("name")
    p.add_argument("tables")
    p = sub.add_parser("validate", help="batches, book and invariants of the tape; 1 if any anomaly")
    p.add_argument("tables")
    p = sub.add_parser("tasks", help="write the task manifest to a new folder")
    p.add_argument("tables")
    p.add_argument("out")
    p = sub.add_parser("trace", help="what a task's worlds decide, send and hear, in order of time; 1 if there is no such task")
    p.add_argument("tables")
    p.add_argument("task", help="such as 2024-01-05:3:B")
    p = sub.add_parser("study", help="write a study's tables to a new folder")
    p.add_argument("tables")
    p.add_argument("out")
    p = sub.add_parser("report", help="report.md of a complete study")
    p.add_argument("out")
    p = sub.add_parser("synth", help="write a synthetic tape")
    p.add_argument("out")
    p.add_argument("--sessions", type=int, default=1)
    p.add_argument("--seconds", type=int, default=60)
    p.add_argument("--seed", type=int, default=0)
    args = parser.parse_args(argv)
    if args.command == "report":
        from tapeloom.study import write_report

        print(write_report(args.out))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tapeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "query":
        from tapeloom import plans

        plans.queries()[args.name](spark, args.tables).show(20, truncate=False)
    elif args.command == "validate":
        from tapeloom import invariants
        from tapeloom.plans.market import Market

        m = Market(spark, args.tables)
        found = invariants.tallies(m.batches, m.states.filter("anomaly is not null")).collect()
        for r in sorted(found):
            print(*r)
        broken = invariants.broken_levels(m.depth()).count()
        return int(broken > 0 or any(r.what != "batch" for r in found))
    elif args.command == "tasks":
        from tapeloom import plans

        plans.queries()["task_manifest"](spark, args.tables).write.mode("errorifexists").parquet(args.out)
    elif args.command == "trace":
        from tapeloom.plans.orders import trace

        found = trace(spark, args.tables, args.task).collect()  # a few rows of one task
        for r in found:
            print(*r)
        return int(not found)
    elif args.command == "study":
        from tapeloom.study import run_study

        run_study(spark, args.tables, args.out)
    elif args.command == "synth":
        from tapeloom.sources.synthetic import SyntheticTape

        spark.dataSource.register(SyntheticTape)
        rows = spark.read.format("synthetic_tape").option("sessions", args.sessions).option("seconds", args.seconds).option("seed", args.seed).load()
        rows.write.mode("errorifexists").partitionBy("session_id").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
