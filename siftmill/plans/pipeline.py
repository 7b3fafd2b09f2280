"""A scan from directory trees to recommendations, written as one partition of each table, with a log of what was done."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..operators import advice, classify, dedup, history, library, relations, scoring
from ..session import stored
from ..sources.filetree import read_tree, validated_roots
from ..sources.samples import contents, sampled
from .functions import imports

C = F.col

_ALL = frozenset({"duplicates", "relations", "recommendations", "intelligence", "library"})
# What each profile works out beyond files, and the domains that it is about (all, if none are named).
PROFILES: dict[str, tuple[frozenset[str], tuple[str, ...]]] = {
    "INTELLIGENCE": (_ALL, ()),
    "INTEL_FAST": (_ALL - {"relations"}, ()),
    "INTEL_SECURITY": (_ALL - {"duplicates", "relations"}, ("CYBER", "FOREN")),
    "INTEL_COMPLIANCE": (_ALL - {"duplicates"}, ("FIN", "LG", "MED", "TAX", "ACCT", "INS")),
    "INTEL_OILFIELD": (_ALL - {"duplicates"}, ("DRL", "FRAC", "PROD", "OFE", "LM", "ENV")),
    "DEDUP": (frozenset({"duplicates", "recommendations"}), ()),
}


#: Files that are read whole for the library, errors and proposals.
LISTED = tuple(dict.fromkeys([*X.LANGUAGES, *X.LOG_FILES, *X.CODE]))


@dataclass
class Scan:
    files: DataFrame
    classifications: DataFrame | None = None
    clusters: DataFrame | None = None
    cluster_members: DataFrame | None = None
    relations: DataFrame | None = None
    scores: DataFrame | None = None
    domain_stats: DataFrame | None = None
    functions: DataFrame | None = None
    library: DataFrame | None = None
    errors: DataFrame | None = None
    recommendations: DataFrame | None = None
    proposals: DataFrame | None = None
    summaries: DataFrame | None = None
    suggestions: DataFrame | None = None
    stages: list[history.Event] = field(default_factory=list)


class Cancelled(Exception):
    """A scan has been told to stop."""


def tag(scan_id: int) -> str:
    return f"siftmill-scan-{scan_id}"


def cancel(spark: SparkSession, scan_id: int) -> None:
    """Stop a running scan: its Spark jobs end, and it is recorded as cancelled."""
    _STOPPED.add(scan_id)
    spark.sparkContext.cancelJobsWithTag(tag(scan_id))


_STOPPED: set[int] = set()


def scan(spark: SparkSession, roots: list[str], scan_id: int, as_of: str, profile: str = "INTELLIGENCE", known: DataFrame | None = None, log: list[history.Event] | None = None, **tree: object) -> Scan:
    """Discover, sample, classify and, as the profile says, cluster, relate, score, extract, recommend, propose and summarise.

    ``known``: files (path, modified_at, size_bytes) of former scans, which are left out if unchanged. Duplicates and
    relations are found before scores are given, so that these know of copies and of the files that name a file. Each
    stage's result is stored before the next begins, and its begin and end are noted in ``log``. Profiles with domains keep the
    recommendations of files whose primary domain is one of them.
    """
    wanted, domains = PROFILES[profile]
    stages = [] if log is None else log

    @contextmanager
    def stage(name: str) -> Iterator[None]:
        if scan_id in _STOPPED:
            raise Cancelled(f"scan {scan_id}")
        stages.append(history.event(scan_id, name, "running"))
        try:
            yield
        except Exception as e:
            stages.append(history.event(scan_id, name, "cancelled" if scan_id in _STOPPED else "failed", f"{type(e).__name__}: {e}"))
            raise
        stages.append(history.event(scan_id, name, "completed"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stored(df, f"scan-{name}")

    out = Scan(files=spark.range(0).toDF("id"), stages=stages)
    with stage("discovery"):
        found = read_tree(spark, validated_roots(roots), **tree)
        if known is not None:
            found = history.changed(found, known)
        files = out.files = kept(sampled(found).withColumn("scan_id", F.lit(scan_id).cast("long")), "files")
    with stage("classification"):
        local = classify.local_classification(files.withColumn("keywords", T.keywords(C("content_sample"))))
        answers = kept(local.withColumn("id", C("file_id")).withColumn("scan_id", F.lit(scan_id).cast("long")), "classes")
        out.classifications = answers if "intelligence" in wanted else None
    found_imports = imports(C("content_sample"), C("extension"))
    references = None
    if "duplicates" in wanted:
        with stage("deduplication"):
            clusters, inside = dedup.keyed_duplicates(files, answers, "keep_newest")
            out.clusters, out.cluster_members = kept(clusters, "clusters"), kept(inside, "members")
    if "relations" in wanted:
        with stage("relationships"):
            out.relations = kept(relations.all_relations(files, answers, found_imports), "relations")
            references = kept(relations.in_degrees(files, found_imports), "references")
    if "intelligence" in wanted:
        with stage("scoring"):
            out.scores = kept(scoring.score_files(files, answers, as_of, references), "scores")
            rated = out.scores.join(files.select(C("id").alias("file_id"), "size_bytes"), "file_id")
            out.domain_stats = kept(rated.groupBy(C("primary_domain").alias("domain")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes"), F.avg("overall").alias("mean_score"), F.avg("quality").alias("mean_quality")), "domains")
    code = stored(contents(files, LISTED), "scan-contents") if "library" in wanted else None
    if "library" in wanted:
        with stage("library"):
            source = code.where(F.lower("extension").isin(*X.LANGUAGES))
            out.functions = kept(library.python_functions(source, "file_id").unionByName(library.script_functions(source, "file_id"), allowMissingColumns=True), "functions")
            out.library = kept(library.extract_all(source, "file_id"), "library")
            out.errors = kept(library.error_patterns(library.errors(code, "file_id")), "errors")
    if "recommendations" in wanted:
        with stage("recommendations"):
            empty = files.select("id").limit(0)
            spare = empty if out.cluster_members is None else out.cluster_members.where("not is_keeper").select(C("file_id").alias("id"))
            copies = relations.duplicates(files).select(F.explode(F.array("source_id", "target_id")).alias("id"))
            scores = scoring.score_files(files, answers, as_of) if out.scores is None else out.scores
            named = {f"{c}_score": C(c) for c in ("sensitivity", "staleness", "importance", "risk")}
            hits = advice.recommended(files, scores.withColumns(named), answers, copies, spare)
            if "intelligence" not in wanted:
                hits = hits.where("category = 'delete'")
            if domains:
                hits = hits.join(scores.where(C("primary_domain").isin(*domains)).select(C("file_id").alias("id")), "id", "left_semi")
            out.recommendations = kept(advice.recommendations(hits), "recommendations")
    if "library" in wanted:
        with stage("proposals"):
            signatures = library.signatures(code, "file_id")
            primary = answers.select(C("file_id").alias("id"), "domain")
            out.proposals = kept(advice.all_proposals(files, primary, signatures, advice.repeated_functions(code.select(C("file_id").alias("id"), "content"))), "proposals")
        with stage("summaries"):
            unfinished = advice.incomplete_projects(files)
            out.summaries = kept(advice.domain_summaries(out.scores.select(C("primary_domain").alias("domain"), "file_id", C("overall").alias("overall_score"))), "summaries")
            out.suggestions = kept(advice.suggestions(out.domain_stats, unfinished, files), "suggestions")
    return out


def write(result: Scan, path: str, scan_id: int) -> list[str]:
    """Append every table of a scan as a partition of its own; returns their names. A scan is never written twice."""
    names = []
    for f in fields(result):
        rows = getattr(result, f.name)
        if isinstance(rows, DataFrame):
            history.append_scan(rows, f"{path}/{f.name}", scan_id)
            names.append(f.name)
    return names


def run(spark: SparkSession, roots: list[str], path: str, scan_id: int, as_of: str, profile: str = "INTELLIGENCE", known: DataFrame | None = None, **tree: object) -> Scan:
    """Scan and write, with the scan's own events and those of its stages in ``path``/events: it ends completed, failed or cancelled."""
    context, log = spark.sparkContext, f"{path}/events"
    history.record(spark, log, [history.event(scan_id, "scan", "running", profile)])
    context.addJobTag(tag(scan_id))
    stages: list[history.Event] = []
    try:
        result = scan(spark, roots, scan_id, as_of, profile, known, stages, **tree)
        write(result, path, scan_id)
        end = history.event(scan_id, "scan", "completed")
        return result
    except Exception as e:
        end = history.event(scan_id, "scan", "cancelled" if scan_id in _STOPPED else "failed", f"{type(e).__name__}: {e}")
        raise
    finally:
        context.removeJobTag(tag(scan_id))
        _STOPPED.discard(scan_id)
        history.record(spark, log, [*stages, end])


def report(recommendations: DataFrame, proposals: DataFrame, most: int = 50) -> str:
    """A short text in light markup of all recommendations and the ``most`` first proposals."""
    lines = ["# Recommendations", ""]
    lines += [f"- **{r['category']}** ({r['severity']}): {r['affected_count']} files, {r['total_bytes']} bytes" for r in recommendations.orderBy("severity_rank", "category").limit(100).collect()]
    lines += ["", "# Proposals", ""]
    lines += [f"- {r['kind']} `{r['subject']}`: {r['files']} files, priority {r['priority']}" for r in proposals.orderBy(F.desc("priority"), "kind", "subject").limit(most).collect()]
    return "\n".join(lines)
