"""Queries that read: points, filters, joins, aggregates, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, reads
from ..operators import relations as R
from ..session import table
from .catalog import query, s
from .dedup import S_EXACT, s_clusters
from .relations import S_ALL, S_DUPLICATES, found

C = F.col

_DIMS = ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in reads.DIMENSIONS)
S_CURRENT = f"SELECT id, file_id, scan_id, {_DIMS}, primary_domain, primary_engine, classification_count, scored_at FROM (SELECT DISTINCT * FROM intelligence_scores) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scored_at DESC NULLS LAST, id DESC NULLS LAST) = 1"
DECIMAL = "decimal(20,6)"


def files(spark, d):
    return table(spark, d, "files")


def scores(spark, d):
    return reads.current_scores(table(spark, d, "intelligence_scores"))


def exact_mean(c):
    """A mean whose sum is decimal, so that its order doesn't matter."""
    return (F.sum(C(c).cast(DECIMAL)).cast("double") / F.count(c)).alias(c)


def s_mean(c: str) -> str:
    return f"sum(CAST({c} AS DECIMAL(20,6)))::DOUBLE / nullif(count({c}), 0)"


@query("q1_file_by_path", r"SELECT id, path, size_bytes FROM files WHERE path = (SELECT min(path) FROM files)")
def q1_file_by_path(spark, d):
    f = files(spark, d)
    return f.join(f.agg(F.min("path").alias("path")), "path").select("id", "path", "size_bytes")


@query("q1_file_by_id", "SELECT id, path, size_bytes FROM files WHERE id = 42")
def q1_file_by_id(spark, d):
    return reads.where_all(files(spark, d), id=42).select("id", "path", "size_bytes")


@query("q2_latest_scans", f"SELECT id, started_at, status FROM scans WHERE status IN ({', '.join(map(s, reads.TERMINAL))}) ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 10")
def q2_latest_scans(spark, d):
    """The ten newest scans that have ended."""
    rows = table(spark, d, "scans").where(C("status").isin(*reads.TERMINAL)).select("id", "started_at", "status")
    return reads.page(rows, [C("started_at").desc_nulls_last(), C("id").desc()], 10)


@query("q3_listed_files", "SELECT id, filename, size_bytes FROM files WHERE drive = 'C:' AND extension = '.md' ORDER BY size_bytes DESC NULLS LAST, id LIMIT 50 OFFSET 10")
def q3_listed_files(spark, d):
    rows = reads.where_all(files(spark, d), drive="C:", extension=".md", scan_id=None).select("id", "filename", "size_bytes")
    return reads.page(rows, [C("size_bytes").desc_nulls_last(), C("id").asc()], 50, 10)


@query("q4_classifications_of_domain", "SELECT id, file_id, topic, score FROM classifications WHERE domain = 'SOFT' AND scan_id = 10")
def q4_classifications_of_domain(spark, d):
    return reads.where_all(table(spark, d, "classifications"), domain="SOFT", scan_id=10).select("id", "file_id", "topic", "score")


@query("q5_current_scores", f"SELECT file_id, id, scan_id, overall_score, risk_score, scored_at FROM ({S_CURRENT})")
def q5_current_scores(spark, d):
    return scores(spark, d).select("file_id", "id", "scan_id", "overall_score", "risk_score", "scored_at")


@query("q5_scores_of_scan", "SELECT DISTINCT file_id, id, CASE WHEN NOT isnan(overall_score) THEN overall_score END AS overall_score FROM intelligence_scores WHERE scan_id = 10")
def q5_scores_of_scan(spark, d):
    rows = reads.where_all(table(spark, d, "intelligence_scores"), scan_id=10)
    return rows.select("file_id", "id", F.when(~F.isnan("overall_score"), C("overall_score")).alias("overall_score")).distinct()


S_A1 = f"SELECT coalesce(nullif(upper(trim(primary_domain)), ''), 'UNKNOWN') AS domain, count(*) AS file_count, CAST(sum(f.size_bytes) AS BIGINT) AS total_bytes, round({s_mean('overall_score')} + 1e-9, 1) AS mean_score FROM ({S_CURRENT}) c JOIN files f ON f.id = c.file_id GROUP BY 1"


def domain_stats(spark, d):
    name = F.coalesce(F.nullif(F.upper(F.trim("primary_domain")), F.lit("")), F.lit("UNKNOWN"))
    rows = scores(spark, d).join(files(spark, d).select(C("id").alias("file_id"), "size_bytes"), "file_id")
    return rows.groupBy(name.alias("domain")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes"), F.round(exact_mean("overall_score") + 1e-9, 1).alias("mean_score"))


@query("a1_domain_stats", S_A1)
def a1_domain_stats(spark, d):
    return domain_stats(spark, d)


@query("q8_domains_by_size", f"SELECT domain, file_count FROM ({S_A1}) ORDER BY file_count DESC, domain LIMIT 20")
def q8_domains_by_size(spark, d):
    return reads.page(domain_stats(spark, d).select("domain", "file_count"), [C("file_count").desc(), C("domain").asc()], 20)


@query("a2_domain_distribution", "SELECT scan_id, domain, count(*) AS classifications FROM classifications GROUP BY ALL")
def a2_domain_distribution(spark, d):
    return table(spark, d, "classifications").groupBy("scan_id", "domain").agg(F.count(F.lit(1)).alias("classifications"))


S_A4 = f"SELECT scan_id, count(*) AS scored, {s_mean('quality_score')} AS mean_quality, {s_mean('importance_score')} AS mean_importance, CAST(count(*) FILTER (WHERE risk_score >= 70) AS BIGINT) AS high_risk, CAST(count(*) FILTER (WHERE sensitivity_score >= 70) AS BIGINT) AS sensitive FROM ({S_CURRENT}) GROUP BY scan_id"


@query("a4_score_summary", S_A4)
def a4_score_summary(spark, d):
    return scores(spark, d).groupBy("scan_id").agg(F.count(F.lit(1)).alias("scored"), exact_mean("quality_score").alias("mean_quality"), exact_mean("importance_score").alias("mean_importance"), F.count_if(C("risk_score") >= 70).alias("high_risk"), F.count_if(C("sensitivity_score") >= 70).alias("sensitive"))


@query("a3_cluster_totals", f"SELECT f.scan_id, count(DISTINCT c.cluster) AS clusters, count(*) AS members FROM ({s_clusters(S_EXACT, 'keep_newest')}) c JOIN ({S_EXACT}) f ON f.cluster = c.cluster GROUP BY f.scan_id")
def a3_cluster_totals(spark, d):
    """Of every scan the clusters that its files are in."""
    keyed = dedup.exact_keys(files(spark, d))
    return keyed.join(dedup.clusters(keyed).select("cluster"), "cluster").groupBy("scan_id").agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("members"))


@query("a5_counts", "SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'classifications', count(*) FROM classifications UNION ALL SELECT 'scores', count(*) FROM intelligence_scores UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'scans', count(*) FROM scans")
def a5_counts(spark, d):
    out = None
    for what, name in (("files", "files"), ("classifications", "classifications"), ("scores", "intelligence_scores"), ("documents", "documents"), ("scans", "scans")):
        n = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("a6_score_histogram", f"SELECT floor(overall_score / 5.0) * 5.0::DOUBLE AS bucket_start, floor(overall_score / 5.0) * 5.0::DOUBLE + 5.0::DOUBLE AS bucket_end, count(*) AS count FROM ({S_CURRENT}) WHERE overall_score IS NOT NULL GROUP BY ALL")
def a6_score_histogram(spark, d):
    return reads.histogram(scores(spark, d), "overall_score")


@query("a9_engine_counts", "SELECT engine_id, mode, count(*) AS classifications, count(DISTINCT file_id) AS files FROM classifications GROUP BY ALL")
def a9_engine_counts(spark, d):
    return table(spark, d, "classifications").groupBy("engine_id", "mode").agg(F.count(F.lit(1)).alias("classifications"), F.count_distinct("file_id").alias("files"))


@query("a13_latencies", "SELECT engine_id, count(response_ms) AS answers, quantile_disc(response_ms, 0.5) AS p50, quantile_disc(response_ms, 0.95) AS p95, quantile_disc(response_ms, 0.99) AS p99 FROM classifications WHERE response_ms IS NOT NULL GROUP BY engine_id")
def a13_latencies(spark, d):
    """Exact percentiles of the answer times of each engine, by counts of equal times."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY response_ms)").cast("int")
    return table(spark, d, "classifications").where("response_ms is not null").groupBy("engine_id").agg(F.count("response_ms").alias("answers"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("a14_tree_identity", "SELECT drive, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(h, '' ORDER BY part)) AS identity FROM (SELECT drive, left(h, 4) AS part, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT drive, sha256(coalesce(path, '') || '|' || coalesce(sha256, '')) AS h FROM files) t GROUP BY drive, left(t.h, 4)) GROUP BY drive")
def a14_tree_identity(spark, d):
    """One hash over the paths and digests of a drive, whatever their order: a tree of 65,536 parts, so no drive is one group."""
    leaves = files(spark, d).select("drive", F.sha2(F.concat(F.coalesce("path", F.lit("")), F.lit("|"), F.coalesce("sha256", F.lit(""))), 256).alias("h"))
    parts = leaves.groupBy("drive", F.substring("h", 1, 4).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "")
    return parts.groupBy("drive").agg(F.sum("n").alias("files"), F.sha2(joined, 256).alias("identity"))


@query("j1_files_of_domain", "SELECT DISTINCT f.id, f.filename FROM files f JOIN intelligence_scores s ON s.file_id = f.id AND s.scan_id = f.scan_id WHERE s.primary_domain = 'SOFT'")
def j1_files_of_domain(spark, d):
    hit = reads.where_all(table(spark, d, "intelligence_scores"), primary_domain="SOFT").select(C("file_id").alias("id"), "scan_id")
    return files(spark, d).join(hit, ["id", "scan_id"], "left_semi").select("id", "filename")


@query("j2_unclassified_files", "SELECT f.id, f.size_bytes FROM files f LEFT JOIN classifications c ON c.file_id = f.id WHERE c.file_id IS NULL")
def j2_unclassified_files(spark, d):
    return reads.unclassified(files(spark, d), table(spark, d, "classifications")).select("id", "size_bytes")


def _top(dimension: str, limit: int = 50) -> str:
    return f"SELECT file_id, {dimension}, filename, size_bytes FROM ({S_CURRENT}) c JOIN files f ON f.id = c.file_id ORDER BY {dimension} DESC NULLS LAST, file_id LIMIT {limit}"


def top(spark, d, dimension: str, limit: int = 50):
    rows = scores(spark, d).join(files(spark, d).select(C("id").alias("file_id"), "filename", "size_bytes"), "file_id").select("file_id", dimension, "filename", "size_bytes")
    return reads.page(rows, [C(dimension).desc_nulls_last(), C("file_id").asc()], limit)


@query("j3_top_scores", _top("overall_score"))
def j3_top_scores(spark, d):
    return top(spark, d, "overall_score")


@query("j3_top_importance", _top("importance_score"))
def j3_top_importance(spark, d):
    return top(spark, d, "importance_score")


@query("j4_high_risk", f"SELECT file_id, risk_score, filename FROM ({S_CURRENT}) c JOIN files f ON f.id = c.file_id WHERE risk_score >= 70")
def j4_high_risk(spark, d):
    return scores(spark, d).where("risk_score >= 70").join(files(spark, d).select(C("id").alias("file_id"), "filename"), "file_id").select("file_id", "risk_score", "filename")


@query("j5_largest_clusters", f"SELECT c.cluster, c.file_count, c.wasted_bytes, string_agg(CAST(f.id AS VARCHAR), ',' ORDER BY f.id) AS members FROM ({s_clusters(S_EXACT, 'keep_newest')} ORDER BY wasted_bytes DESC, cluster LIMIT 100) c JOIN ({S_EXACT}) f ON f.cluster = c.cluster GROUP BY ALL")
def j5_largest_clusters(spark, d):
    """The hundred clusters that waste most, with the ids of their files."""
    keyed = dedup.exact_keys(files(spark, d))
    most = reads.page(dedup.clusters(keyed), [C("wasted_bytes").desc(), C("cluster").asc()], 100)
    return keyed.select("cluster", "id").join(most, "cluster").groupBy("cluster", "file_count", "wasted_bytes").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("members"))


@query("j6_clusters_of_scan", f"SELECT c.cluster, c.file_count FROM ({s_clusters(S_EXACT, 'keep_newest')}) c WHERE EXISTS (SELECT 1 FROM ({S_EXACT}) f WHERE f.cluster = c.cluster AND f.scan_id = 10)")
def j6_clusters_of_scan(spark, d):
    keyed = dedup.exact_keys(files(spark, d))
    return dedup.clusters(keyed).join(keyed.where("scan_id = 10").select("cluster"), "cluster", "left_semi").select("cluster", "file_count")


@query("j7_search", f"SELECT f.id, f.filename, c.overall_score, c.primary_domain FROM files f LEFT JOIN ({S_CURRENT}) c ON c.file_id = f.id WHERE filename ILIKE '%Password%' OR path ILIKE '%Password%' OR content_sample ILIKE '%Password%' ORDER BY coalesce(overall_score, 0) DESC, f.id LIMIT 50")
def j7_search(spark, d):
    return reads.search(files(spark, d), scores(spark, d), "Password", 50)


@query(
    "q9_file_details",
    f"""WITH e AS (SELECT unnest([source_id, target_id]) AS id FROM ({S_DUPLICATES}))
SELECT f.id, f.filename, f.size_bytes, c.overall_score, c.risk_score, coalesce(k.n, 0) AS classifications, coalesce(x.n, 0) AS duplicate_edges FROM files f LEFT JOIN ({S_CURRENT}) c ON c.file_id = f.id
LEFT JOIN (SELECT file_id, count(*) AS n FROM classifications GROUP BY file_id) k ON k.file_id = f.id LEFT JOIN (SELECT id, count(*) AS n FROM e GROUP BY id) x ON x.id = f.id""",
)
def q9_file_details(spark, d):
    f = files(spark, d)
    return reads.file_details(f, scores(spark, d), table(spark, d, "classifications"), R.duplicates(f))


@query(
    "q11_scan_summaries",
    f"""SELECT s.id AS scan_id, s.status, coalesce(f.n, 0) AS files, CAST(coalesce(f.b, 0) AS BIGINT) AS bytes, coalesce(k.n, 0) AS classified, coalesce(a.scored, 0) AS scored, a.mean_quality, coalesce(a.high_risk, 0) AS high_risk, epoch(s.completed_at - s.started_at)::DOUBLE AS seconds
FROM scans s LEFT JOIN (SELECT scan_id, count(*) AS n, sum(size_bytes) AS b FROM files GROUP BY scan_id) f ON f.scan_id = s.id LEFT JOIN (SELECT scan_id, count(DISTINCT file_id) AS n FROM classifications GROUP BY scan_id) k ON k.scan_id = s.id LEFT JOIN ({S_A4}) a ON a.scan_id = s.id""",
)
def q11_scan_summaries(spark, d):
    """One row for each scan: aggregates are made before they are joined."""
    f = files(spark, d).groupBy("scan_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    k = table(spark, d, "classifications").groupBy("scan_id").agg(F.count_distinct("file_id").alias("classified"))
    seconds = ((F.unix_micros(C("completed_at").cast("timestamp")) - F.unix_micros(C("started_at").cast("timestamp"))) / 1e6).alias("seconds")
    out = table(spark, d, "scans").select(C("id").alias("scan_id"), "status", seconds).join(f, "scan_id", "left").join(k, "scan_id", "left").join(a4_score_summary(spark, d).select("scan_id", "scored", "mean_quality", "high_risk"), "scan_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files", "bytes", "classified", "scored", "high_risk")})


@query("q9_one_file", f"""SELECT f.id, f.filename, c.overall_score, (SELECT string_agg(domain || ':' || coalesce(topic, ''), ' ' ORDER BY k.id) FROM classifications k WHERE k.file_id = f.id) AS classifications,
(SELECT string_agg(kind || ':' || source_id || '>' || target_id, ' ' ORDER BY kind, source_id, target_id) FROM ({S_ALL}) e WHERE e.source_id = f.id OR e.target_id = f.id) AS edges FROM files f LEFT JOIN ({S_CURRENT}) c ON c.file_id = f.id WHERE f.id = 7""")
def q9_one_file(spark, d):
    """One file with its score and lists of its classifications and edges of all kinds."""
    rows, classifications = files(spark, d), table(spark, d, "classifications")
    listed = lambda found_, text, *order: found_.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("t")))), lambda x: x["t"]), " ").alias("x")).select(F.nullif("x", F.lit("")).alias("x"))
    own = listed(classifications.where("file_id = 7"), F.concat("domain", F.lit(":"), F.coalesce("topic", F.lit(""))), "id")
    edges = listed(R.edges_of(rows, classifications, found(), 7), F.concat("kind", F.lit(":"), C("source_id").cast("string"), F.lit(">"), C("target_id").cast("string")), "kind", "source_id", "target_id")
    score = scores(spark, d).where("file_id = 7").select(C("file_id").alias("id"), "overall_score")
    one = rows.where("id = 7").select("id", "filename").join(score, "id", "left")
    return one.select("id", "filename", "overall_score", own.scalar().alias("classifications"), edges.scalar().alias("edges"))
