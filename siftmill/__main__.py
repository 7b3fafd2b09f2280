"""Command line: scan directory trees, read what scans have found, run registered queries."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import history
from .plans import pipeline
from .plans.all import QUERIES
from .session import build_session


def of_scan(spark: SparkSession, tables: str, name: str, scan_id: int | None) -> DataFrame:
    """A table of one scan, the last one if none is named."""
    rows = history.read_scans(spark, f"{tables}/{name}")
    wanted = rows.agg(F.max("scan_id")).first()[0] if scan_id is None else scan_id
    return rows.where(F.col("scan_id") == wanted)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftmill", description=__doc__)
    p.add_argument("--master", help="Spark master, as local[8]")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="scan directory trees and write the tables of the scan")
    scan.add_argument("roots", nargs="+")
    scan.add_argument("--tables", required=True)
    scan.add_argument("--scan-id", type=int, required=True)
    scan.add_argument("--profile", choices=sorted(pipeline.PROFILES), default="INTELLIGENCE")
    scan.add_argument("--as-of", default=datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"))
    scan.add_argument("--changed-since", type=int, help="leave out what this scan has seen unchanged")
    for name, text in (("status", "stages of scans"), ("domains", "files by domain"), ("duplicates", "clusters of duplicates, the most wasteful first"), ("recommendations", "what to do"), ("report", "recommendations and proposals as text")):
        one = sub.add_parser(name, help=text)
        one.add_argument("--tables", required=True)
        one.add_argument("--scan-id", type=int)
        one.add_argument("--limit", type=int, default=20)
    find = sub.add_parser("search", help="files whose name, path or sample holds a text")
    find.add_argument("text")
    find.add_argument("--tables", required=True)
    find.add_argument("--scan-id", type=int)
    find.add_argument("--limit", type=int, default=20)
    query = sub.add_parser("query", help="a registered query over a folder of tables")
    query.add_argument("name", choices=sorted(QUERIES), metavar="name")
    query.add_argument("folder")
    query.add_argument("--limit", type=int, default=20)
    sub.add_parser("queries", help="names of all registered queries")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parser().parse_args(arguments)
    if given.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return
    spark = spark or build_session(master=given.master)
    if given.command == "query":
        QUERIES[given.name](spark, given.folder).show(given.limit, truncate=80)
    elif given.command == "scan":
        known = None if given.changed_since is None else of_scan(spark, given.tables, "files", given.changed_since)
        found = pipeline.run(spark, given.roots, given.tables, given.scan_id, given.as_of, given.profile, known)
        print(f"scan {given.scan_id}: {found.files.count()} files")
    elif given.command == "status":
        history.states(spark.read.parquet(f"{given.tables}/events")).orderBy("scan_id", "started_at").show(given.limit, truncate=60)
    elif given.command == "domains":
        of_scan(spark, given.tables, "domain_stats", given.scan_id).orderBy(F.desc("file_count"), "domain").show(given.limit, truncate=60)
    elif given.command == "duplicates":
        of_scan(spark, given.tables, "clusters", given.scan_id).orderBy(F.desc("wasted_bytes"), "cluster").show(given.limit, truncate=60)
    elif given.command == "recommendations":
        of_scan(spark, given.tables, "recommendations", given.scan_id).orderBy("severity_rank", "category").show(given.limit, truncate=60)
    elif given.command == "report":
        print(pipeline.report(of_scan(spark, given.tables, "recommendations", given.scan_id), of_scan(spark, given.tables, "proposals", given.scan_id), given.limit))
    elif given.command == "search":
        from .operators import reads

        scores = of_scan(spark, given.tables, "scores", given.scan_id).withColumn("overall_score", F.col("overall"))
        reads.search(of_scan(spark, given.tables, "files", given.scan_id), scores, given.text, given.limit).show(given.limit, truncate=60)


if __name__ == "__main__":
    main()
