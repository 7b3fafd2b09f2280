"""Queries of histories and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import history
from ..session import shared_dir, table
from ..sources import filetree, samples, sinks
from ..streaming import batches, guards
from .catalog import query

C = F.col

#: Scans up to this one are known, later ones are found; those between are in both.
KNOWN, FOUND = 28, 20
_COLUMNS = ["id", "path", "size_bytes", "modified_at", "scan_id", "first_seen_scan_id", "last_modified_scan_id"]


def _sides(spark, d):
    rows = table(spark, d, "files").select(*_COLUMNS)
    return rows.where(C("scan_id") <= KNOWN), rows.where(C("scan_id") > FOUND).withColumn("scan_id", C("scan_id") + 100).withColumn("modified_at", F.when(C("size_bytes") > 1000, F.concat("modified_at", F.lit("+"))).otherwise(C("modified_at")))


S_SIDES = f"k AS (SELECT {', '.join(_COLUMNS)} FROM files WHERE scan_id <= {KNOWN}), f AS (SELECT id, path, size_bytes, CASE WHEN size_bytes > 1000 THEN modified_at || '+' ELSE modified_at END AS modified_at, scan_id + 100 AS scan_id, first_seen_scan_id, last_modified_scan_id FROM files WHERE scan_id > {FOUND})"


@query("t2_changed_files", f"WITH {S_SIDES} SELECT id, path FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.path IS NOT DISTINCT FROM f.path AND k.modified_at IS NOT DISTINCT FROM f.modified_at AND k.size_bytes IS NOT DISTINCT FROM f.size_bytes)")
def t2_changed_files(spark, d):
    """Files of a scan that aren't known with their time and size."""
    known, found = _sides(spark, d)
    return history.changed(found, known).select("id", "path")


@query(
    "k1_merged_files",
    f"""WITH {S_SIDES} SELECT coalesce(k.id, f.id) AS id, CASE WHEN f.id IS NOT NULL THEN f.path ELSE k.path END AS path, CASE WHEN f.id IS NOT NULL THEN f.size_bytes ELSE k.size_bytes END AS size_bytes, CASE WHEN f.id IS NOT NULL THEN f.modified_at ELSE k.modified_at END AS modified_at,
CASE WHEN f.id IS NOT NULL THEN f.scan_id ELSE k.scan_id END AS scan_id, coalesce(k.first_seen_scan_id, f.scan_id) AS first_seen_scan_id, CASE WHEN k.id IS NOT NULL AND f.id IS NOT NULL AND k.modified_at IS DISTINCT FROM f.modified_at THEN f.scan_id ELSE k.last_modified_scan_id END AS last_modified_scan_id
FROM k FULL OUTER JOIN f ON k.path IS NOT DISTINCT FROM f.path""",
)
def k1_merged_files(spark, d):
    """The current files after a scan."""
    return history.merged(*_sides(spark, d))


@query("k2_new_observations", f"WITH {S_SIDES} SELECT DISTINCT f.id, f.scan_id FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = f.id AND k.scan_id = f.scan_id)")
def k2_new_observations(spark, d):
    known, found = _sides(spark, d)
    return history.new_rows(found.select("id", "scan_id"), known, ["id", "scan_id"]).select("id", "scan_id")


@query("k10_distinct_library_rows", "SELECT DISTINCT file_id, domain, topic FROM classifications")
def k10_distinct_library_rows(spark, d):
    rows = table(spark, d, "classifications").select("file_id", "domain", "topic")
    return history.new_rows(rows, rows.limit(0), ["file_id", "domain", "topic"])


@query("k11_last_events", "SELECT user_id, event_type, ts, event_id, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def k11_last_events(spark, d):
    """The last event of each user and kind, as the last stage of a scan is read from its log."""
    return history.latest_events(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id")


@query("k3_appended_scan", "SELECT id, file_id, scan_id, overall_score FROM intelligence_scores WHERE scan_id = 10")
def k3_appended_scan(spark, d):
    """The rows of a scan, written as a partition of their own and read again."""
    rows = table(spark, d, "intelligence_scores").where("scan_id = 10").select("id", "file_id", "scan_id", "overall_score")
    place = f"{shared_dir(spark).rstrip('/')}/siftmill/{spark.sparkContext.applicationId}/appended-{uuid.uuid4().hex}"
    history.append_scan(rows, place, 10)
    return history.read_scans(spark, place).select("id", "file_id", C("scan_id").cast("long"), "overall_score")


@query("k16_json_lines", "SELECT id, drives, profile, status FROM scans")
def k16_json_lines(spark, d):
    """Rows written as lines of JSON and read again."""
    rows = table(spark, d, "scans").select("id", "drives", "profile", "status")
    place = f"{shared_dir(spark).rstrip('/')}/siftmill/{spark.sparkContext.applicationId}/lines-{uuid.uuid4().hex}"
    sinks.write_json(rows, place)
    return spark.read.schema(rows.schema).json(place)


_STATUS = "CASE WHEN value > 20 THEN 'failed' WHEN value > 10 THEN 'completed' ELSE 'running' END"


@query("k7_last_statuses", f"SELECT t.event_type, coalesce((SELECT {_STATUS} AS status FROM events e WHERE e.event_type = t.event_type AND e.value > 15 ORDER BY e.ts DESC, status DESC LIMIT 1), 'open') AS status FROM (SELECT DISTINCT event_type FROM events) t")
def k7_last_statuses(spark, d):
    """The last status that a log of changes gives each item, as recommendations have it."""
    events = table(spark, d, "events")
    changes = events.where("value > 15").select("event_type", F.expr(_STATUS).alias("status"), C("ts").alias("at"))
    return history.with_status(events.select("event_type").distinct(), ["event_type"], changes)


@query(
    "k11_stage_states",
    f"""WITH e AS (SELECT user_id AS scan_id, event_type AS stage, {_STATUS} AS status, ts FROM events), l AS (SELECT *, status <> 'running' AS ended FROM e QUALIFY row_number() OVER (PARTITION BY scan_id, stage ORDER BY ts DESC, status <> 'running' DESC, status DESC) = 1)
SELECT l.scan_id, l.stage, l.status, m.started_at, CASE WHEN l.ended THEN l.ts END AS completed_at FROM l JOIN (SELECT scan_id, stage, min(ts) AS started_at FROM e GROUP BY ALL) m ON m.scan_id = l.scan_id AND m.stage = l.stage""",
)
def k11_stage_states(spark, d):
    """The state of every stage from a log of events: begun, ended, its last status."""
    events = table(spark, d, "events").select(C("user_id").alias("scan_id"), C("event_type").alias("stage"), F.expr(_STATUS).alias("status"), C("ts").alias("at"), F.lit(None).cast("string").alias("detail"))
    return history.states(events).drop("detail")


@query("s1_tree")
def s1_tree(spark, d):
    """The files of a directory tree, here of the folder with the tables itself."""
    return filetree.read_tree(spark, filetree.validated_roots([d])).select("filename", "extension", "size_bytes")


@query("s5_sampled_tree")
def s5_sampled_tree(spark, d):
    """Signature, hashes, type and domain of the files of a tree."""
    return samples.sampled(filetree.read_tree(spark, filetree.validated_roots([d]))).select("filename", "file_signature", "sha256", "xxhash", "mime_type", "detected_domain", "error")


@query("s16_storage")
def s16_storage(spark, d):
    """How full the drive with the tables is."""
    return sinks.storage_summary(spark, [d]).select("anchor", "status")


@query("t6_sliding_rates", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def t6_sliding_rates(spark, d):
    return guards.sliding_counts(table(spark, d, "events"), "user_id", "ts").select("event_id", "user_id", "in_window")


@query("t6_breaker")
def t6_breaker(spark, d):
    """The state of a breaker for each kind of event after a stream of all events; large values count as failures."""
    states = batches.last_states(guards.breaker(batches.stream_table(spark, f"{d}/events.parquet"), "event_type", "ts", "event_id", "value > 20"))
    return states.groupBy("key").agg(F.max(F.struct("batch", "calls", "turned_away", "opened", "state")).alias("m")).select(C("key").alias("event_type"), "m.calls", "m.turned_away", "m.opened", "m.state")


@query("t1_streamed_domain_counts", "SELECT domain, count(*) AS classifications FROM classifications GROUP BY domain")
def t1_streamed_domain_counts(spark, d):
    """Counts kept up by a stream of micro-batches: the last update of each domain counts."""
    counts = batches.stream_table(spark, f"{d}/classifications.parquet").groupBy("domain").agg(F.count(F.lit(1)).alias("classifications"))
    updates = batches.last_states(counts)
    return updates.groupBy("domain").agg(F.max(F.struct("batch", "classifications")).alias("m")).select("domain", "m.classifications")


@query("f5_json_keys")
def f5_json_keys(spark, d):
    """Keys and depth of samples that are whole JSON."""
    return samples.json_facts(table(spark, d, "files").where("extension = '.json'"), "id", "content_sample")
