"""Queries of recommendations, proposals and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import advice, dedup, history, library
from ..operators import relations as R
from ..session import table
from .catalog import query, s, s_contains, s_in
from .dedup import S_EXACT, s_clusters
from .library import S_CODE, code, s_signatures
from .reads import S_CURRENT, domain_stats, files, scores
from .relations import S_DUPLICATES

C = F.col
T = X.THRESHOLDS

_P = "lower(path)"
_RULES = {
    "secure": f"sensitivity_score >= {T['secure_sensitivity']} AND NOT {s_contains(_P, X.SECURE_WORDS)}",
    "encrypt": f"sensitivity_score >= {T['encrypt_sensitivity']} AND NOT {s_in('lower(ltrim(extension, chr(46)))', X.ENCRYPTED_FILES)}",
    "review": f"risk_score >= {T['review_risk']}",
    "archive": f"staleness_score >= {T['archive_staleness']} AND importance_score <= {T['archive_importance']}",
    "update": f"staleness_score >= {T['update_staleness']} AND importance_score >= {T['update_importance']}",
    "organize": f"{s_in('primary_domain', X.DOMAIN_FOLDERS)} AND {s_contains(_P, X.TEMPORARY_WORDS)}",
    "backup": f"importance_score >= {T['backup_importance']} AND id NOT IN (SELECT unnest([source_id, target_id]) FROM ({S_DUPLICATES}))",
}
S_HITS = (
    "WITH r AS (SELECT f.id, f.path, f.extension, f.size_bytes, c.sensitivity_score, c.staleness_score, c.importance_score, c.risk_score, c.primary_domain FROM files f JOIN (" + S_CURRENT + ") c ON c.file_id = f.id) "
    + " UNION ALL ".join(f"SELECT {s(k)} AS category, id, size_bytes FROM r WHERE {v}" for k, v in _RULES.items())
    + f" UNION ALL SELECT 'alert', id, size_bytes FROM files WHERE id IN (SELECT file_id FROM classifications WHERE domain = 'CYBER' AND score >= {T['alert_score']})"
    + f" UNION ALL SELECT 'delete', k.id, k.size_bytes FROM ({S_EXACT}) k JOIN ({s_clusters(S_EXACT, 'keep_newest')}) c ON c.cluster = k.cluster WHERE k.id <> c.keeper_id"
)
_SEVERITY = "CASE category " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in advice.SEVERITY.items()) + " END"
S_RECOMMENDATIONS = f"""SELECT category, severity, CAST(list_position([{', '.join(map(s, X.SEVERITIES))}], severity) AS INT) AS severity_rank, affected_count, total_bytes, affected
FROM (SELECT category, {_SEVERITY} AS severity, count(*) AS affected_count, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS total_bytes, array_to_string(list_slice(list_sort(list(id)), 1, {advice.SHOWN}), ',') AS affected FROM ({S_HITS}) GROUP BY category)"""


def hits(spark, d):
    f = files(spark, d)
    keyed = dedup.exact_keys(f)
    spare = dedup.members(keyed, dedup.clusters(keyed)).where("not is_keeper").select(C("file_id").alias("id"))
    copies = R.duplicates(f).select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return advice.recommended(f, scores(spark, d), table(spark, d, "classifications"), copies, spare)


@query("g0_recommendations", S_RECOMMENDATIONS)
def g0_recommendations(spark, d):
    """All nine kinds of recommendation, one row each."""
    return advice.recommendations(hits(spark, d))


@query("g1_recommended_files", S_HITS)
def g1_recommended_files(spark, d):
    """Every file that a recommendation is about."""
    return hits(spark, d)


@query("a8_recommendation_totals", f"SELECT severity, count(*) AS categories, CAST(sum(affected_count) AS BIGINT) AS affected FROM ({S_RECOMMENDATIONS}) GROUP BY severity")
def a8_recommendation_totals(spark, d):
    return advice.recommendations(hits(spark, d)).groupBy("severity").agg(F.count(F.lit(1)).alias("categories"), F.sum("affected_count").alias("affected"))


@query("q6_high_recommendations", f"SELECT category, affected_count FROM ({S_RECOMMENDATIONS}) WHERE severity = 'high'")
def q6_high_recommendations(spark, d):
    return advice.recommendations(hits(spark, d)).where("severity = 'high'").select("category", "affected_count")


# --- proposals ----------------------------------------------------------------------------------------------------------------


def s_priority(n: str, b: str, known: str, fragments: str, data: str) -> str:
    return f"""least(100.0::DOUBLE, round((CASE WHEN {n} >= 100 THEN 25.0 WHEN {n} >= 20 THEN 15.0 WHEN {n} >= 5 THEN 8.0 ELSE 3.0 END)::DOUBLE + (CASE WHEN {b} >= 1000000000 THEN 15.0 WHEN {b} >= 100000000 THEN 10.0 WHEN {b} >= 10000000 THEN 5.0 ELSE 0.0 END)::DOUBLE
+ (CASE WHEN {known} THEN 20.0 ELSE 0.0 END)::DOUBLE + least(20.0::DOUBLE, ({fragments})::DOUBLE * 100.0::DOUBLE) + least(20.0::DOUBLE, ({data})::DOUBLE * 20.0::DOUBLE) + 1e-9::DOUBLE, 1))"""


_KINDS = ", ".join(f"count(*) FILTER (WHERE {s_in('extension', v)}) AS {k}" for k, v in (("code", X.CODE), ("data", X.DATA), ("docs", X.DOCS)))
S_DOMAINS = f"""WITH g AS (SELECT coalesce(c.primary_domain, 'UNKNOWN') AS domain, count(*) AS n, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS b, {_KINDS} FROM files f LEFT JOIN ({S_CURRENT}) c ON c.file_id = f.id GROUP BY 1)
SELECT 'DATA_PIPELINE' AS kind, domain AS subject, n AS files, b AS bytes, {s_priority('n', 'b', s_in('domain', X.ENGINE_DOMAINS), '0.0', 'data::DOUBLE / n::DOUBLE')} AS priority FROM g WHERE n >= 3 AND data > 5 AND code = 0
UNION ALL SELECT 'KNOWLEDGE_API', domain, n, b, {s_priority('n', 'b', s_in('domain', X.ENGINE_DOMAINS), '0.1', '0.5')} FROM g WHERE n >= 3 AND docs > 10 AND data > 3 AND code < 3"""
_ISCODE = s_in("extension", X.CODE)
S_PARTIAL = f"""WITH g AS (SELECT parent_dir, count(*) AS n, CAST(sum(coalesce(f.size_bytes, 0)) AS BIGINT) AS b, count(*) FILTER (WHERE {_ISCODE}) AS code, count(*) FILTER (WHERE {_ISCODE} AND len(fragments) > 0) AS fr,
{', '.join(f"coalesce(bool_or({_ISCODE} AND {c}), false) AS {c}" for c in X.CAPABILITIES)} FROM files f LEFT JOIN ({s_signatures(S_CODE)}) x ON x.id = f.id GROUP BY parent_dir)
SELECT 'PROMOTE_PARTIAL' AS kind, parent_dir AS subject, n AS files, b AS bytes, {s_priority('n', 'b', 'false', 'fr::DOUBLE / greatest(1, code)::DOUBLE', '0.0')} AS priority FROM g WHERE n >= 3 AND code >= 2 AND fr::DOUBLE / greatest(1, code) > 0.3 AND (has_main OR has_cli OR has_api)"""
S_REPEATED = f"SELECT name, count(*) AS files FROM (SELECT file_id, unnest(list_distinct(regexp_extract_all(content, {s(X.FUNCTION_NAME)}, 1))) AS name FROM {S_CODE}) WHERE length(name) > 4 GROUP BY name HAVING count(*) >= 3"
S_LIBRARY = f"SELECT 'SHARED_LIBRARY' AS kind, 'functions' AS subject, files, CAST(0 AS BIGINT) AS bytes, least(100.0::DOUBLE, 40.0::DOUBLE + n * 1.5::DOUBLE) AS priority FROM (SELECT count(*) AS n, CAST(sum(files) AS BIGINT) AS files FROM ({S_REPEATED})) WHERE n >= 5"
S_VIEWER = f"""WITH g AS (SELECT parent_dir, count(*) AS n, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS b FROM files WHERE {s_in('extension', X.DATA)} GROUP BY parent_dir HAVING sum(coalesce(size_bytes, 0)) >= 1000000)
SELECT 'DATA_VIEWER' AS kind, parent_dir AS subject, n AS files, b AS bytes, {s_priority('n', 'b', 'false', '0.0', '1.0')} AS priority FROM g WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.parent_dir = g.parent_dir AND {_ISCODE} AND NOT {s_in('extension', X.DATA)})"""
_ABLE = " + ".join(f"{c}::INT" for c in X.CAPABILITIES)
S_SCRIPT = f"""SELECT 'PROMOTE_SCRIPT' AS kind, f.path AS subject, CAST(1 AS BIGINT) AS files, f.size_bytes AS bytes, least(100.0::DOUBLE, round(35.0::DOUBLE + len(list_distinct(functions)) * 0.8::DOUBLE + ({_ABLE}) * 5.0::DOUBLE + 1e-9::DOUBLE, 1)) AS priority
FROM files f JOIN ({s_signatures(S_CODE)}) x ON x.id = f.id WHERE f.extension IN ('.py', '.js', '.ts', '.ps1') AND f.size_bytes > 15000 AND (({_ABLE}) >= 3 OR (len(list_distinct(functions)) >= 15 AND len(list_distinct(classes)) >= 2))"""
S_PROPOSALS = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (S_DOMAINS, S_PARTIAL, S_LIBRARY, S_VIEWER, S_SCRIPT))


def signatures(spark, d):
    return library.signatures(code(spark, d), "file_id")


def domain_of(spark, d):
    return scores(spark, d).select(C("file_id").alias("id"), C("primary_domain").alias("domain"))


def repeated(spark, d):
    return advice.repeated_functions(code(spark, d).select(C("file_id").alias("id"), "content"))


def proposals(spark, d):
    return advice.all_proposals(files(spark, d), domain_of(spark, d), signatures(spark, d), repeated(spark, d))


@query("prop1_domains", S_DOMAINS)
def prop1_domains(spark, d):
    return advice.domain_proposals(files(spark, d), domain_of(spark, d))


@query("prop3_partial_projects", S_PARTIAL)
def prop3_partial_projects(spark, d):
    return advice.partial_projects(files(spark, d), signatures(spark, d))


@query("a12_repeated_functions", S_REPEATED)
def a12_repeated_functions(spark, d):
    return repeated(spark, d)


@query("prop5_orphaned_data", S_VIEWER)
def prop5_orphaned_data(spark, d):
    return advice.orphaned_data(files(spark, d))


@query("prop6_large_scripts", S_SCRIPT)
def prop6_large_scripts(spark, d):
    return advice.large_scripts(files(spark, d), signatures(spark, d))


@query("prop7_all", S_PROPOSALS)
def prop7_all(spark, d):
    return proposals(spark, d)


@query("prop8_completions", f"SELECT kind, count(*) AS proposals, max(priority) AS highest FROM ({S_PROPOSALS}) WHERE starts_with(kind, 'PROMOTE_') GROUP BY kind")
def prop8_completions(spark, d):
    """Proposals to complete what is there, by kind; the others are to build something new."""
    return proposals(spark, d).where(C("kind").startswith("PROMOTE_")).groupBy("kind").agg(F.count(F.lit(1)).alias("proposals"), F.max("priority").alias("highest"))


@query("a10_proposal_totals", f"SELECT CASE WHEN starts_with(kind, 'PROMOTE_') THEN 'completion' ELSE 'new_build' END AS purpose, count(*) AS proposals FROM ({S_PROPOSALS}) GROUP BY 1")
def a10_proposal_totals(spark, d):
    purpose = F.when(C("kind").startswith("PROMOTE_"), "completion").otherwise("new_build")
    return proposals(spark, d).groupBy(purpose.alias("purpose")).agg(F.count(F.lit(1)).alias("proposals"))


_NAMED = f"SELECT file_id, overall_score, coalesce(nullif(upper(trim(primary_domain)), ''), 'UNKNOWN') AS domain FROM ({S_CURRENT})"


def named_scores(spark, d):
    return scores(spark, d).select("file_id", "overall_score", F.coalesce(F.nullif(F.upper(F.trim("primary_domain")), F.lit("")), F.lit("UNKNOWN")).alias("domain"))


@query("x1_domain_summaries", f"SELECT domain, CAST(r AS INT) AS place, file_id, overall_score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY overall_score DESC NULLS LAST, file_id) AS r FROM ({_NAMED})) WHERE r <= 5")
def x1_domain_summaries(spark, d):
    return advice.domain_summaries(named_scores(spark, d))


def _s_met() -> str:
    out = []
    for k, (kind, patterns) in enumerate(X.PROJECTS.items()):
        for p in patterns:
            folder, _, leaf = p.rpartition("/")
            hit = f"ends_with(filename, {s(leaf[1:])})" if leaf.startswith("*") else f"filename = {s(leaf)}"
            where = r"regexp_extract(parent_dir, '^(.*)[/\\]([^/\\]+)$', 1)" if folder else "parent_dir"
            more = rf" AND regexp_extract(parent_dir, '^(.*)[/\\]([^/\\]+)$', 2) = {s(folder)}" if folder else ""
            out.append(f"SELECT {where} AS dir, {k} AS k, {s(p)} AS pattern FROM files WHERE {hit}{more}")
    return " UNION ".join(out)


_TOTAL = "CASE k " + " ".join(f"WHEN {i} THEN {len(p)}" for i, p in enumerate(X.PROJECTS.values())) + " END"
_NAME = "CASE k " + " ".join(f"WHEN {i} THEN {s(n)}" for i, n in enumerate(X.PROJECTS)) + " END"
S_INCOMPLETE = f"""WITH m AS ({_s_met()}), f AS (SELECT dir, k, count(*) AS found, {_TOTAL} AS total FROM m WHERE dir IN (SELECT parent_dir FROM files GROUP BY parent_dir HAVING count(*) >= 2) GROUP BY dir, k),
p AS (SELECT *, round(found / total::DOUBLE * 100 + 1e-9, 1) AS pct FROM f WHERE found < total), q AS (SELECT * FROM p WHERE pct < 90 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY k) = 1)
SELECT dir, {_NAME} AS project, found, total, pct FROM q ORDER BY pct DESC, dir LIMIT 100"""


@query("x2_incomplete_projects", S_INCOMPLETE)
def x2_incomplete_projects(spark, d):
    return advice.incomplete_projects(files(spark, d))


_STATS = f"SELECT domain, count(*) AS n, avg(quality_score) FILTER (WHERE NOT isnan(quality_score)) AS q FROM (SELECT file_id, quality_score, coalesce(nullif(upper(trim(primary_domain)), ''), 'UNKNOWN') AS domain FROM ({S_CURRENT})) c JOIN files f ON f.id = c.file_id GROUP BY domain"
S_SUGGESTIONS = f"""SELECT subject, reason, priority, weight FROM (
SELECT domain AS subject, 'dashboard' AS reason, CASE WHEN n > 200 THEN 'high' ELSE 'medium' END AS priority, n AS weight FROM ({_STATS}) WHERE n > 50 AND domain NOT IN ('PROG', 'UNKNOWN')
UNION ALL SELECT domain, 'engine', 'medium', n FROM ({_STATS}) WHERE q > {X.GOOD_QUALITY} AND NOT {s_in('domain', X.ENGINE_TIERS)}
UNION ALL SELECT project, 'unfinished', 'low', count(*) FROM ({S_INCOMPLETE}) GROUP BY project HAVING count(*) >= 3
UNION ALL SELECT 'PROG', 'debt', 'medium', count(*) FROM files WHERE regexp_matches(content_sample, {s(X.OPEN_TASK)}) HAVING count(*) > 20)
ORDER BY list_position(['high', 'medium', 'low'], priority), weight DESC, subject, reason LIMIT 20"""


@query("x3_suggestions", S_SUGGESTIONS)
def x3_suggestions(spark, d):
    name = F.coalesce(F.nullif(F.upper(F.trim("primary_domain")), F.lit("")), F.lit("UNKNOWN"))
    rated = scores(spark, d).join(files(spark, d).select(C("id").alias("file_id")), "file_id")
    stats = rated.groupBy(name.alias("domain")).agg(F.count(F.lit(1)).alias("file_count"), F.avg(F.when(~F.isnan("quality_score"), C("quality_score"))).alias("mean_quality"))
    return advice.suggestions(stats, advice.incomplete_projects(files(spark, d)), files(spark, d))


@query(
    "q10_export_report",
    f"""SELECT 'domain' AS section, domain AS name, CAST(n AS BIGINT) AS value FROM (SELECT domain, count(*) AS n FROM ({_NAMED}) c JOIN files f ON f.id = c.file_id GROUP BY domain)
UNION ALL SELECT 'recommendation', category, CAST(affected_count AS BIGINT) FROM ({S_RECOMMENDATIONS}) UNION ALL SELECT 'proposal', kind, count(*) FROM ({S_PROPOSALS}) GROUP BY kind UNION ALL SELECT 'scan', coalesce(status, ''), count(*) FROM scans GROUP BY 2
UNION ALL SELECT 'stage', event_type, count(*) FROM (SELECT event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) GROUP BY event_type
UNION ALL SELECT 'timeline', CAST(id AS VARCHAR), CAST(epoch_us(started_at) // 1000000 AS BIGINT) FROM (SELECT id, started_at FROM scans ORDER BY id DESC LIMIT 20)""",
)
def q10_export_report(spark, d):
    """What a report of the corpus says, as (section, name, value)."""
    line = lambda rows, section, name, value: rows.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(value).cast("long").alias("value"))
    found = proposals(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    scans = table(spark, d, "scans").groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    stages = history.latest_events(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    timeline = table(spark, d, "scans").orderBy(F.desc("id")).limit(20).select(C("id").cast("string").alias("name"), F.unix_seconds(C("started_at").cast("timestamp")).alias("value"))
    parts = [line(domain_stats(spark, d), "domain", "domain", "file_count"), line(advice.recommendations(hits(spark, d)), "recommendation", "category", "affected_count"), line(found, "proposal", "kind", "n"), line(scans, "scan", "status", "n"), line(stages, "stage", "event_type", "n"), line(timeline, "timeline", "name", "value")]
    return reduce(lambda a, b: a.unionByName(b), parts)
