"""Queries of the scores and of classification answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import classify, scoring
from ..session import table
from .catalog import AS_OF, query, s_any, s_contains, s_days, s_has, s_in, s_ladder, s_lookup, s_words

C = F.col

S_DIGEST = r"regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '^sha256:\s*', '')"


def s_digest(c: str) -> str:
    d = S_DIGEST.format(c=c)
    return f"CASE WHEN regexp_matches({d}, '^[0-9a-f]{{64}}$') AND {d} <> repeat('0', 64) THEN {d} END"


def s_weighted(weights: dict, factors: dict) -> str:
    return "round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 0.0::DOUBLE" + "".join(f" + ({factors[k]})::DOUBLE * {w}::DOUBLE" for k, w in weights.items()) + ")) + 1e-9, 1)"


def s_when(*cases, otherwise="0.0") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


_T = "coalesce(content_sample, '')"
_W = s_words(_T)
_THERE = "coalesce(length({}) > 0, false)"
S_QUALITY = s_weighted(
    X.QUALITY_WEIGHTS,
    {
        "length": s_when(("size_bytes > 0", "least(100.0::DOUBLE, log10(size_bytes::DOUBLE) / 5.0::DOUBLE * 100.0::DOUBLE)")),
        "density": s_when((f"len({_W}) > 0", f"least(100.0::DOUBLE, len(list_distinct(list_transform(list_filter({_W}, lambda y: length(y) > 2), lambda z: lower(z))))::DOUBLE / len({_W})::DOUBLE * 200.0::DOUBLE)")),
        "structure": f"{s_when((s_has(_T, '(?m)^#{1,6}\\s|^[A-Z][A-Z\\s]{5,}$'), 30.0))} + {s_when((f'len(string_split({_T}, chr(10) || chr(10))) - 1 > 2', 25.0))} + {s_when((s_has(_T, '(?m)^\\s*[-*]\\s|^\\s*\\d+\\.\\s'), 25.0))} + {s_when((s_has(_T, '```|def\\s|class\\s|function\\s|import\\s'), 20.0))}",
        "matches": "least(100.0::DOUBLE, matches * 20.0::DOUBLE)",
        "match_score": "least(100.0::DOUBLE, match_score)",
        "completeness": f"{s_when((_THERE.format('content_sample'), 30.0))} + {s_when((_THERE.format('sha256'), 20.0))} + {s_when(('matches > 0', 30.0))} + {s_when((_THERE.format('mime_type'), 20.0))}",
    },
)
IMPORTANCE = {
        "criticality": f"coalesce(criticality, {X.NO_CRITICALITY})",
        "authority": "least(100.0, coalesce(authority, 0))",
        "recency": s_ladder("days_accessed", scoring.RECENCY, 5.0),
        "references": "0.0",
        "uniqueness": s_when(("copies = 0", 100.0), ("copies = 1", 60.0), ("copies <= 3", 35.0), otherwise="10.0"),
        "depth": s_when(("depth <= 2", 100.0), ("depth <= 4", 70.0), ("depth <= 6", 40.0), otherwise="15.0"),
}
S_IMPORTANCE = s_weighted(X.IMPORTANCE_WEIGHTS, IMPORTANCE)
_N, _E, _P = "lower(filename)", "coalesce(lower(extension), '')", "lower(path)"
S_SENSITIVITY = f"""round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, greatest(greatest({', '.join(s_when((s_has(_T, p), float(w))) for p, w in X.SENSITIVE.values())})::DOUBLE + coalesce(boost, 0.0),
{s_when((s_in('lower(extension)', X.KEY_FILES), 90.0), (s_in('lower(extension)', X.DUMP_FILES), 40.0))}, {s_when((s_contains(_N, X.SECRET_NAMES), 85.0), (s_contains(_N, X.PERSONAL_NAMES), 80.0))}))) + 1e-9, 1)"""
_BASE = s_ladder("days_modified", scoring.AGE, 90.0)
S_UNIQUE = s_when(("copies <= 1", 100.0), ("copies = 2", 50.0), ("copies <= 5", 25.0), otherwise="round(greatest(5.0::DOUBLE, 100.0::DOUBLE / copies), 1)")
S_RISK = f"""round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, ({s_when((f'sensitivity > 70 AND NOT {s_any(_P, X.ENCRYPTED_PLACES)}', 40.0))})::DOUBLE
+ {s_when((f'{s_in(_E, X.EXECUTABLE)} AND {s_contains(_P, ("temp", "tmp", "download", "appdata"))}', 60.0), (f'{s_in(_E, X.EXECUTABLE)} AND {s_contains(_P, ("desktop", "public"))}', 40.0))}
+ {s_when(('cyber IS NOT NULL', 'least(50.0::DOUBLE, cyber)'))} + {s_when((f'sensitivity > 50 AND {s_any(_P, X.SHARED_PLACES)}', 30.0))}
+ {s_when((f'{s_in(_E, (".bat", ".cmd", ".vbs", ".ps1", ".hta"))} AND cyber IS NULL', 20.0))} + {s_when((f'{s_in(_E, (".env", ".cfg", ".ini", ".conf"))} AND {s_contains("lower(content_sample)", ("password",))}', 35.0))})) + 1e-9, 1)"""
S_OVERALL = "round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 0.0::DOUBLE" + "".join(f" + {w}::DOUBLE * {k}" if w >= 0 else f" + {-w}::DOUBLE * (100.0::DOUBLE - {k})" for k, w in X.OVERALL_WEIGHTS.items()) + ")) + 1e-9, 1)"
S_FACTS = f"""cls AS (SELECT file_id, count(*) AS matches, sum(CAST(coalesce(score, 0.0) AS DECIMAL(20,6)))::DOUBLE / count(*) AS match_score, max(authority_weight) AS authority,
  max({s_lookup("coalesce(domain, '')", X.CRITICALITY, str(X.OTHER_CRITICALITY))}) AS criticality, sum({s_lookup("coalesce(domain, '')", X.SENSITIVE_DOMAINS, '0')})::DOUBLE * 0.5::DOUBLE AS boost, max(coalesce(score, 0.0)) FILTER (WHERE domain = 'CYBER') AS cyber,
  first(domain ORDER BY coalesce(score, 0.0) DESC, id) AS best_domain, first(engine_id ORDER BY coalesce(score, 0.0) DESC, id) AS best_engine FROM classifications GROUP BY file_id),
dig AS (SELECT {s_digest('sha256')} AS g, count(*) AS copies FROM files GROUP BY 1 HAVING count(*) > 1),
fact AS (SELECT f.*, coalesce(dig.copies, 0) AS copies, coalesce(cls.matches, 0) AS matches, coalesce(cls.match_score, 0.0) AS match_score, cls.authority, cls.criticality, cls.boost, cls.cyber, cls.best_domain, cls.best_engine,
  {s_days('modified_at')} AS days_modified, {s_days('accessed_at')} AS days_accessed FROM files f LEFT JOIN dig ON dig.g = {s_digest('f.sha256')} LEFT JOIN cls ON cls.file_id = f.id)"""
S_SCORES = f"""WITH {S_FACTS},
one AS (SELECT *, {S_SENSITIVITY} AS sensitivity, {_BASE}::DOUBLE AS base0 FROM fact),
two AS (SELECT *, CASE WHEN days_accessed > 730 AND base0 > 50 THEN least(100.0::DOUBLE, base0 + 10.0) ELSE base0 END AS base1 FROM one),
three AS (SELECT *, {S_QUALITY} AS quality, {S_IMPORTANCE} AS importance, round(CASE WHEN days_accessed < 30 AND base1 > 50 THEN base1 * 0.6::DOUBLE ELSE base1 END + 1e-9, 1) AS staleness, ({S_UNIQUE})::DOUBLE AS uniqueness, {S_RISK} AS risk FROM two)
SELECT id AS file_id, quality, importance, sensitivity, staleness, uniqueness, risk, {S_OVERALL} AS overall, coalesce(best_domain, 'UNKNOWN') AS primary_domain, coalesce(best_engine, '') AS primary_engine, matches AS classification_count FROM three"""


def scored(spark, d):
    return scoring.score_files(table(spark, d, "files"), table(spark, d, "classifications"), AS_OF)


@query("c_scores", S_SCORES)
def c_scores(spark, d):
    """All six dimensions and the overall score of every file."""
    return scored(spark, d)


def s_scores_with_references(references: str) -> str:
    """S_SCORES in which importance knows of the files that name or import a file; references: (id, n) of the files that have any."""
    counted = "least(100.0::DOUBLE, coalesce(refs.n, 0) * 15.0::DOUBLE)"
    facts = S_FACTS.replace("fact AS (SELECT f.*,", f"refs AS ({references}), fact AS (SELECT f.*, {counted} AS referenced,").replace("LEFT JOIN cls ON", "LEFT JOIN refs ON refs.id = f.id LEFT JOIN cls ON")
    importance = s_weighted(X.IMPORTANCE_WEIGHTS, IMPORTANCE | {"references": "referenced"})
    return S_SCORES.replace(S_FACTS, facts).replace(S_IMPORTANCE, importance)


@query("c8_domain_distribution", "SELECT file_id, domain, sum(CAST(coalesce(score, 0.0) AS DECIMAL(20,6)))::DOUBLE AS score FROM classifications GROUP BY ALL")
def c8_domain_distribution(spark, d):
    return scoring.domain_distribution(table(spark, d, "classifications"))


def _s_best(domains: int, each: int) -> str:
    return f"""WITH t AS (SELECT file_id, domain, row_number() OVER (PARTITION BY file_id ORDER BY sum(CAST(score AS DECIMAL(20,6))) DESC NULLS LAST, domain NULLS FIRST) AS domain_rank FROM classifications GROUP BY file_id, domain),
r AS (SELECT c.file_id, c.domain, c.id, c.score, t.domain_rank, row_number() OVER (PARTITION BY c.file_id, c.domain ORDER BY c.score DESC NULLS LAST, c.id) AS rank FROM classifications c JOIN t ON t.file_id = c.file_id AND t.domain = c.domain WHERE t.domain_rank <= {domains})
SELECT file_id, domain, id, score, CAST(domain_rank AS INT) AS domain_rank, CAST(rank AS INT) AS rank FROM r WHERE rank <= {each}"""


def _best(spark, d, domains: int, each: int):
    return classify.best_of_domains(table(spark, d, "classifications"), domains, each).select("file_id", "domain", "id", "score", "domain_rank", "rank")


@query("k1_fast_answers", _s_best(1, 3))
def k1_fast_answers(spark, d):
    return _best(spark, d, 1, 3)


@query("k2_explored_answers", _s_best(3, 2))
def k2_explored_answers(spark, d):
    return _best(spark, d, 3, 2)


@query("k3_deep_answers", _s_best(2, 3))
def k3_deep_answers(spark, d):
    return _best(spark, d, 2, 3)


@query(
    "k5_classified_with_fallback",
    """WITH b AS (SELECT file_id, first(domain ORDER BY score DESC NULLS LAST, id) AS domain, first(score ORDER BY score DESC NULLS LAST, id) AS score, first(engine_id ORDER BY score DESC NULLS LAST, id) AS engine_id FROM classifications GROUP BY file_id)
SELECT f.id AS file_id, coalesce(b.domain, f.detected_domain, 'UNKNOWN') AS domain, coalesce(b.score, greatest(0.0, least(1.0, coalesce(f.domain_confidence, 0.0)))) AS score, coalesce(b.engine_id, 'LOCAL_RULES_V1') AS engine_id FROM files f LEFT JOIN b ON b.file_id = f.id""",
)
def k5_classified_with_fallback(spark, d):
    files = table(spark, d, "files")
    local = classify.local_classification(files.withColumn("keywords", F.array().cast("array<string>")))
    return classify.with_fallback(files, table(spark, d, "classifications"), local)
