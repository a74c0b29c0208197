"""Commands: python -m skyledger normalize | report | verify | download-plan | simulate."""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def periods(texts: list[str]) -> list[tuple[int, int]]:
    """Months named YYYY-MM, each once, in order."""
    out = set()
    for t in texts:
        if not re.fullmatch(r"\d{4}-\d{2}", t) or not 1 <= int(t[5:]) <= 12:
            raise ValueError(f"{t} is no month")
        out.add((int(t[:4]), int(t[5:])))
    return sorted(out)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="skyledger")
    sub = top.add_subparsers(dest="command", required=True)
    n = sub.add_parser("normalize", help="archives to a snapshot")
    n.add_argument("archives", nargs="+")
    n.add_argument("--reference", required=True, help="Parquet of airports")
    n.add_argument("--overrides", help="Parquet of reviewed overrides")
    n.add_argument("--output", required=True)
    n.add_argument("--tolerance", type=int, default=0)
    for p in (n,):
        p.add_argument("--historical", type=int, nargs="*", default=[])
        p.add_argument("--evaluation", type=int, nargs="*", default=[])
    for name, text in (("report", "quality counts of a snapshot"), ("verify", "checks a snapshot against its manifest")):
        sub.add_parser(name, help=text).add_argument("snapshot")
    d = sub.add_parser("download-plan", help="archives that months need")
    d.add_argument("start", type=int)
    d.add_argument("end", type=int)
    d.add_argument("--month", type=int)
    s = sub.add_parser("simulate", help="plays trips over offers")
    s.add_argument("requests")
    s.add_argument("offers")
    s.add_argument("--output", required=True)
    s.add_argument("--agent", choices=["earliest", "random"], default="earliest")
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--max-decisions", type=int, default=4)
    s.add_argument("--minutes", type=int, default=1440)
    s.add_argument("--verify-episodes", action="store_true")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("skyledger").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return globals()["run_" + args.command.replace("-", "_")](spark, args)


def run_normalize(spark: SparkSession, args) -> int:
    from .operators import airports as A
    from .operators import normalize as N
    from .plans.raw_view import overrides as none
    from .sources import archives, snapshot

    reference = spark.read.parquet(args.reference)
    overrides = spark.read.parquet(args.overrides) if args.overrides else none(spark).limit(0)
    A.check_overrides(overrides)
    records = archives.read_archives(spark, args.archives)
    flights = N.normalize(N.widen(records), reference, overrides, args.tolerance)
    seen = A.observed(flights, "flight_date", *[(f"{r}_airport_id", f"{r}_mapping", F.col(f"{r}_state_name")) for r in ("origin", "destination")])
    sources = sorted(r["sha256"] for r in records.select("sha256").distinct().collect())  # one for each archive
    print(snapshot.publish(flights, seen, args.output, {"sources": sources, "tolerance": args.tolerance, "version": 1}, args.historical, args.evaluation))
    return 0


def run_report(spark: SparkSession, args) -> int:
    from .operators import normalize as N

    flights = spark.read.parquet(f"{args.snapshot}/flights")
    out = {"issues": N.issue_counts(flights), "nulls": N.null_counts(flights), "facts": N.fact_counts(flights), "stops": N.stop_fact_counts(flights), "categories": flights.groupBy("outcome_category").count()}
    print(json.dumps({k: [r.asDict() for r in df.collect()] for k, df in out.items()}, sort_keys=True))
    return 0


def run_verify(spark: SparkSession, args) -> int:
    from .sources import snapshot

    print(json.dumps(snapshot.verify(spark, args.snapshot)["totals"]))
    return 0


def run_download_plan(spark: SparkSession, args) -> int:
    from .functions.scalars import archive_name
    from .sources.archives import requested_months

    for r in requested_months(spark, args.start, args.end, args.month).select(archive_name(F.col("year").cast("string"), F.col("month").cast("string")).alias("name")).collect():
        print(r["name"])
    return 0


def run_simulate(spark: SparkSession, args) -> int:
    from .operators import rollout as R
    from .plans.tables import Tables

    tables = Tables(spark, "simulate")
    requests, offers = spark.read.parquet(args.requests), spark.read.parquet(args.offers)
    choose = R.greedy if args.agent == "earliest" else lambda found: R.random_offer(found, args.seed)
    done, steps = R.rollout(requests, offers, tables, args.max_decisions, args.minutes, choose)
    done.write.parquet(f"{args.output}/episodes")
    steps.write.parquet(f"{args.output}/steps")
    if args.verify_episodes and args.agent == "earliest":
        return 0 if R.verify_steps(requests, offers, spark.read.parquet(f"{args.output}/steps"), args.minutes).limit(1).isEmpty() else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
