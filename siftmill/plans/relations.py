"""Queries of the edges between files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import relations as R
from ..operators import scoring
from ..session import table
from .catalog import AS_OF, query, s
from .functions import S_LEAF_STEM, imports, s_imports, s_stem
from .scores import s_digest, s_scores_with_references

C = F.col


def s_edges(source: str, target: str, kind: str, confidence: object = None) -> str:
    return f"{source} AS source_id, {target} AS target_id, {s(kind)} AS kind, CAST({R.CONFIDENCE.get(kind) if confidence is None else confidence} AS DOUBLE) AS confidence"


S_DUPLICATES = f"WITH k AS (SELECT id, {s_digest('sha256')} AS g FROM files) SELECT {s_edges('f', 'id', 'duplicates')} FROM (SELECT id, min(id) OVER (PARTITION BY g) AS f FROM k WHERE g IS NOT NULL) WHERE id <> f"
S_VERSIONED = f"""WITH e AS ({' UNION ALL '.join(f"SELECT id, coalesce(modified_at, '') AS t, {s_stem('filename')} AS stem, {i} AS mark FROM files WHERE regexp_matches(filename, {s(p)})" for i, p in enumerate(X.VERSIONS))}),
b AS (SELECT stem, min(mark) AS mark FROM (SELECT stem, mark FROM e GROUP BY stem, mark HAVING count(*) > 1) GROUP BY stem)
SELECT {s_edges('id', 'n', 'versioned')} FROM (SELECT e.id, lead(e.id) OVER (PARTITION BY e.stem ORDER BY e.t, e.id) AS n FROM e JOIN b ON b.stem = e.stem AND b.mark = e.mark) WHERE n IS NOT NULL"""
S_REFERENCES = f"""SELECT {s_edges('f.id', 'g.id', 'references')} FROM (SELECT id, lower(content_sample) AS t, lower(filename) AS own FROM files WHERE length(content_sample) > 0) f
JOIN (SELECT id, lower(filename) AS name FROM files WHERE length(filename) >= 5) g ON contains(f.t, g.name) AND (g.name <> f.own OR f.own IS NULL) AND g.id <> f.id"""
_S_LAST = r"list_last(string_split(lower(replace(replace(trim(import), '.', '/'), '::', '/')), '/'))"
S_DEPENDS = f"""WITH u AS (SELECT id, parent_dir, unnest({s_imports('content_sample', 'extension')}) AS import FROM files WHERE length(content_sample) > 0),
c AS (SELECT id, parent_dir, lower({S_LEAF_STEM.format(c='filename')}) AS stem FROM files),
p AS (SELECT row_number() OVER () AS n, * FROM u),
m AS (SELECT p.n, p.id, p.import, min(c.id) AS target FROM p JOIN c ON c.parent_dir = p.parent_dir AND c.stem = {_S_LAST} AND c.id <> p.id GROUP BY p.n, p.id, p.import)
SELECT {s_edges('id', 'target', 'depends_on')}, import FROM m"""
S_CO = f"""WITH t AS (SELECT DISTINCT concat_ws(':', domain, topic) AS topic, file_id FROM classifications), f AS (SELECT topic, file_id FROM t QUALIFY row_number() OVER (PARTITION BY topic ORDER BY file_id) <= 20),
p AS (SELECT x.file_id AS a, y.file_id AS b, count(*) AS n, array_to_string(list_slice(list_sort(list(x.topic)), 1, 5), ', ') AS topics FROM f x JOIN f y ON y.topic = x.topic AND x.file_id < y.file_id GROUP BY ALL HAVING count(*) >= 3)
SELECT {s_edges('a', 'b', 'co_classified', 'least(1.0, round(n * 0.15, 2))')}, topics FROM p"""
S_SUPERSEDES = f"""WITH b AS (SELECT file_id, first(domain ORDER BY coalesce(score, 0.0) DESC, id) AS domain FROM classifications GROUP BY file_id),
e AS (SELECT f.id, f.modified_at, b.domain, {s_stem('f.filename')} AS stem FROM files f JOIN b ON b.file_id = f.id WHERE length(f.modified_at) > 0)
SELECT {s_edges('newest', 'id', 'supersedes')} FROM (SELECT *, first(id) OVER w AS newest, first(modified_at) OVER w AS top FROM e WINDOW w AS (PARTITION BY domain, stem ORDER BY modified_at DESC, id)) WHERE top > modified_at"""
S_ALL = " UNION ALL ".join(f"SELECT source_id, target_id, kind, confidence FROM ({q})" for q in (S_DUPLICATES, S_VERSIONED, S_REFERENCES, S_DEPENDS, S_CO, S_SUPERSEDES))


def found():
    return imports(C("content_sample"), C("extension"))


def _all(spark, d):
    return R.all_relations(table(spark, d, "files"), table(spark, d, "classifications"), found())


@query("r1_duplicates", S_DUPLICATES)
def r1_duplicates(spark, d):
    return R.duplicates(table(spark, d, "files"))


@query("r2_versioned", S_VERSIONED)
def r2_versioned(spark, d):
    return R.versioned(table(spark, d, "files"))


@query("r3_references", S_REFERENCES)
def r3_references(spark, d):
    return R.references(table(spark, d, "files"))


@query("r4_depends_on", S_DEPENDS)
def r4_depends_on(spark, d):
    return R.depends_on(table(spark, d, "files"), found())


@query("r5_co_classified", S_CO)
def r5_co_classified(spark, d):
    return R.co_classified(table(spark, d, "classifications"))


@query("r6_supersedes", S_SUPERSEDES)
def r6_supersedes(spark, d):
    return R.supersedes(table(spark, d, "files"), table(spark, d, "classifications"))


@query("r7_relation_counts", f"SELECT kind, count(*) AS edges FROM ({S_ALL}) GROUP BY kind")
def r7_relation_counts(spark, d):
    return _all(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


@query("r3_mentions", f"""SELECT f.id AS source_id, n.name, n.files FROM (SELECT id, lower(content_sample) AS t, lower(filename) AS own FROM files WHERE length(content_sample) > 0) f
JOIN (SELECT lower(filename) AS name, count(*) AS files FROM files WHERE length(filename) >= 5 GROUP BY 1) n ON contains(f.t, n.name) AND (n.name <> f.own OR f.own IS NULL)""")
def r3_mentions(spark, d):
    """The names that occur in texts, with how many files have them: a row for each text and name, however common the name is."""
    files = table(spark, d, "files")
    named = files.groupBy(F.lower("filename").alias("name")).agg(F.count(F.lit(1)).alias("files"))
    return R.mentions(files).join(named, "name").select(C("source").alias("source_id"), "name", "files")


@query("j8_edges_of_file", f"SELECT * FROM ({S_ALL}) WHERE source_id = 7 OR target_id = 7")
def j8_edges_of_file(spark, d):
    """All edges from and to one file."""
    return R.edges_of(table(spark, d, "files"), table(spark, d, "classifications"), found(), 7)


S_REFERENCED = f"SELECT id, sum(n) AS n FROM (SELECT target_id AS id, count(*) AS n FROM ({S_REFERENCES}) GROUP BY 1 UNION ALL SELECT target_id, count(DISTINCT source_id) FROM ({S_DEPENDS}) GROUP BY 1) GROUP BY id"


@query("c2_scores_with_references", s_scores_with_references(S_REFERENCED))
def c2_scores_with_references(spark, d):
    """All scores, importance with the number of files that name or import a file."""
    files = table(spark, d, "files")
    return scoring.score_files(files, table(spark, d, "classifications"), AS_OF, R.in_degrees(files, found()))

