"""Tables with a history: append-only observations, current state, change detection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def same(a: str, b: str, columns: Sequence[str]):
    """Equality of columns of two aliased tables in which nulls are equal."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & C(f"{a}.{c}").eqNullSafe(C(f"{b}.{c}"))
    return cond


def changed(found: DataFrame, known: DataFrame, by: Sequence[str] = ("path", "modified_at", "size_bytes")) -> DataFrame:
    """What has been found and isn't known with the same time and size."""
    return found.alias("f").join(known.alias("k"), same("f", "k", by), "left_anti")


def merged(known: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """The current state after a scan: a found row replaces the known one of its key, keeping its id and first scan.

    ``last_modified_scan_id`` moves to the new scan only if modified_at has changed. Rows that weren't found stay. Both
    sides have one row for each key.
    """
    k, f = known.alias("k"), found.alias("f")
    both = k.join(f, C(f"k.{key}").eqNullSafe(C(f"f.{key}")), "full_outer")
    there, new = C("k.id").isNotNull(), C("f.id").isNotNull()
    out = []
    for c in known.columns:
        if c in ("id", "first_seen_scan_id"):
            value = F.coalesce(C(f"k.{c}"), C("f.id") if c == "id" else C("f.scan_id"))
        elif c == "last_modified_scan_id":
            value = F.when(there & new & ~C("k.modified_at").eqNullSafe(C("f.modified_at")), C("f.scan_id")).otherwise(C("k.last_modified_scan_id"))
        else:
            value = F.when(new, C(f"f.{c}")).otherwise(C(f"k.{c}"))
        out.append(value.alias(c))
    return both.select(*out)


def new_rows(rows: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key isn't stored yet, one for each key: what an append may add."""
    return rows.dropDuplicates(list(key)).alias("r").join(stored.alias("s"), same("r", "s", key), "left_anti")


def append_scan(rows: DataFrame, path: str, scan_id: int) -> None:
    """Write the rows of a scan as a partition of its own; a scan that is there already is never written again."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scan_id={scan_id}")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(f"scan {scan_id} has been written")
    rows.drop("scan_id").write.mode("error").parquet(f"{path}/scan_id={scan_id}")


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_events(events: DataFrame, keys: Sequence[str], at: str, id: str) -> DataFrame:
    """The last event of every key."""
    rest = [c for c in events.columns if c not in (*keys, at, id)]
    return events.groupBy(*keys).agg(F.max(F.struct(at, id, *rest)).alias("m")).select(*keys, f"m.{at}", f"m.{id}", *[f"m.{c}" for c in rest])


#: An entry of the log of scans: scan, stage ("scan" for the scan itself), status, time, detail.
Event = tuple[int, str, str, datetime, str | None]
EVENTS = "scan_id long, stage string, status string, at timestamp, detail string"
ENDS = ("completed", "cancelled", "failed")
LONGEST_DETAIL = 1000


def event(scan_id: int, stage: str, status: str, detail: str | None = None) -> Event:
    return scan_id, stage, status, datetime.now(UTC), detail[:LONGEST_DETAIL] if detail else None


def record(spark: SparkSession, path: str, events: Sequence[Event]) -> None:
    """Append events to a log; nothing is ever changed in it."""
    spark.createDataFrame(list(events), EVENTS).coalesce(1).write.mode("append").parquet(path)


def states(events: DataFrame) -> DataFrame:
    """(scan_id, stage, status, started_at, completed_at, detail) of every stage; completed_at only where it has ended."""
    ended = C("status").isin(*ENDS)
    last = F.max(F.struct("at", ended.alias("ended"), "status", "detail"))
    out = events.groupBy("scan_id", "stage").agg(F.min("at").alias("started_at"), last.alias("m"))
    return out.select("scan_id", "stage", "m.status", "started_at", F.when(C("m.ended"), C("m.at")).alias("completed_at"), "m.detail")


def with_status(rows: DataFrame, key: Sequence[str], changes: DataFrame, first: str = "open") -> DataFrame:
    """Rows with the last status that ``changes`` (key, status, at) gives them, or ``first``."""
    last = changes.groupBy(*key).agg(F.max(F.struct("at", "status")).alias("m")).select(*key, C("m.status").alias("status"))
    return rows.drop("status").join(last, list(key), "left").withColumn("status", F.coalesce("status", F.lit(first)))
