"""Command line: `python -m stationlake audit FILE` checks a station document. Exit code 0: clean, 1: flagged, 2: error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit
from .sources import feeds

RULES = [f"A{i}" for i in range(1, 8)]


def report(verdict: DataFrame) -> list[dict]:
    """Per system: stations, flagged ones and hits of each rule."""
    hits = [F.sum(F.coalesce(F.col(r), F.lit(False)).cast("long")).alias(r) for r in RULES]
    rows = verdict.groupBy("system_id").agg(F.count("*").alias("n"), F.sum(F.col("flagged").cast("long")).alias("flagged"), *hits).orderBy("system_id").collect()
    return [{"system_id": r.system_id, "n_stations": r.n, "n_flagged": r.flagged, "flagged_pct": round(100 * r.flagged / r.n, 2), "rules": {k: r[k] for k in RULES}} for r in rows]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stationlake")
    command = parser.add_subparsers(dest="command", required=True).add_parser("audit", help="audit station documents")
    command.add_argument("source", help="JSON file, folder or pattern that Spark can read")
    command.add_argument("--system-id", default="system")
    command.add_argument("--a7-scope", choices=("docked", "all"), default="docked")
    command.add_argument("--out", help="folder for the verdicts as CSV")
    command.add_argument("--json", action="store_true", help="print JSON")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        info = feeds.station_info(feeds.read_documents(spark, args.source, args.system_id))
        verdict = audit.audit_static(info, a7_scope=args.a7_scope)
        if args.out:
            verdict.write.csv(args.out, header=True)
        found = report(verdict)
    except (PySparkException, OSError, ValueError) as e:
        print(f"error: {e}".splitlines()[0], file=sys.stderr)
        return 2
    if not found:
        print("error: no stations in the document", file=sys.stderr)
        return 2
    if args.json:
        print(json.dumps(found, indent=2))
    else:
        for f in found:
            print(f"{f['system_id']}: {f['n_stations']} stations, {f['n_flagged']} flagged ({f['flagged_pct']} %)", *(f"  {k}: {v}" for k, v in f["rules"].items() if v), sep="\n")
    return int(any(f["n_flagged"] for f in found))


if __name__ == "__main__":
    sys.exit(main())
