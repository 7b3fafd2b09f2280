"""What to do about files: recommendations, project proposals, summaries of domains and of unfinished projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T

C = F.col
#: Ids that a recommendation shows; its counts are over all.
SHOWN = 500

SEVERITY = {"alert": "critical", "secure": "high", "encrypt": "high", "review": "high", "backup": "high", "delete": "medium", "update": "medium", "archive": "low", "organize": "low"}


def recommended(files: DataFrame, scores: DataFrame, classifications: DataFrame, copies: DataFrame, spare: DataFrame) -> DataFrame:
    """(category, id, size_bytes) of every file that a recommendation is about.

    copies: ids with an edge of duplicates; spare: ids of files of clusters other than the one kept. All conditions on
    scores are evaluated in one pass over the files with their scores.
    """
    t = X.THRESHOLDS
    rated = files.select("id", "path", "extension", "size_bytes").join(scores.select(C("file_id").alias("id"), "sensitivity_score", "staleness_score", "importance_score", "risk_score", "primary_domain"), "id")
    path = F.lower("path")
    rules: dict[str, Column] = {
        "secure": (C("sensitivity_score") >= t["secure_sensitivity"]) & ~T.has_any(path, X.SECURE_WORDS),
        "encrypt": (C("sensitivity_score") >= t["encrypt_sensitivity"]) & ~F.coalesce(F.lower(F.ltrim(C("extension"), F.lit("."))).isin(*X.ENCRYPTED_FILES), F.lit(False)),
        "review": C("risk_score") >= t["review_risk"],
        "archive": (C("staleness_score") >= t["archive_staleness"]) & (C("importance_score") <= t["archive_importance"]),
        "update": (C("staleness_score") >= t["update_staleness"]) & (C("importance_score") >= t["update_importance"]),
        "organize": C("primary_domain").isin(*X.DOMAIN_FOLDERS) & T.has_any(path, X.TEMPORARY_WORDS),
    }
    flags = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    by_score = rated.select(F.explode(flags).alias("category"), "id", "size_bytes")
    important = rated.where(C("importance_score") >= t["backup_importance"]).join(copies.distinct(), "id", "left_anti")
    alarming = files.join(classifications.where((C("domain") == "CYBER") & (C("score") >= t["alert_score"])).select(C("file_id").alias("id")), "id", "left_semi")
    waste = files.join(spare, "id", "left_semi")
    out = by_score
    for name, rows in (("backup", important), ("alert", alarming), ("delete", waste)):
        out = out.unionByName(rows.select(F.lit(name).alias("category"), "id", "size_bytes"))
    return out


def recommendations(hits: DataFrame) -> DataFrame:
    """One row per category: severity, its rank, affected_count, total_bytes and the first ids.

    The ids are ranked with a limit that acts before the shuffle, so a category of all files is a few ids per task.
    """
    place = F.row_number().over(Window.partitionBy("category").orderBy("id"))
    shown = hits.withColumn("place", place).where(C("place") <= SHOWN).groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("affected"))
    total = hits.groupBy("category").agg(F.count(F.lit(1)).alias("affected_count"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_bytes"))
    severity = F.create_map(*[F.lit(x) for item in SEVERITY.items() for x in item])[C("category")]
    rank = F.array_position(F.array(*map(F.lit, X.SEVERITIES)), severity).cast("int")
    return total.join(shown, "category").select("category", severity.alias("severity"), rank.alias("severity_rank"), "affected_count", "total_bytes", "affected")


# --- proposals --------------------------------------------------------------------------------------------------------------


def priority(files: Column, size: Column, known: Column, fragments: Column, data: Column) -> Column:
    """Points for number, size, a known domain, share of fragments and share of data without code."""
    total = (
        F.when(files >= 100, 25.0).when(files >= 20, 15.0).when(files >= 5, 8.0).otherwise(3.0)
        + F.when(size >= 1_000_000_000, 15.0).when(size >= 100_000_000, 10.0).when(size >= 10_000_000, 5.0).otherwise(0.0)
        + F.when(known, 20.0).otherwise(0.0)
        + F.least(F.lit(20.0), fragments * 100.0)
        + F.least(F.lit(20.0), data * 20.0)
    )
    return F.least(F.lit(100.0), F.round(total + 1e-9, 1))


def kinds(prefix: str = "") -> list[Column]:
    ext = C("extension")
    return [F.count_if(ext.isin(*v)).alias(prefix + k) for k, v in (("code", X.CODE), ("data", X.DATA), ("docs", X.DOCS))]


def domain_proposals(files: DataFrame, domains: DataFrame) -> DataFrame:
    """Domains with data but no code (DATA_PIPELINE), and with documents and data but hardly any code (KNOWLEDGE_API)."""
    named = files.join(domains, "id", "left").withColumn("domain", F.coalesce("domain", F.lit("UNKNOWN")))
    g = named.groupBy("domain").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"), *kinds())
    known = C("domain").isin(*X.ENGINE_DOMAINS)
    pipeline = g.where("files >= 3 and data > 5 and code = 0").select(F.lit("DATA_PIPELINE").alias("kind"), C("domain").alias("subject"), "files", "bytes", priority(C("files"), C("bytes"), known, F.lit(0.0), C("data") / C("files")).alias("priority"))
    knowledge = g.where("files >= 3 and docs > 10 and data > 3 and code < 3").select(F.lit("KNOWLEDGE_API").alias("kind"), C("domain").alias("subject"), "files", "bytes", priority(C("files"), C("bytes"), known, F.lit(0.1), F.lit(0.5)).alias("priority"))
    return pipeline.unionByName(knowledge)


def partial_projects(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """Directories of three files or more with code that is fragmentary but can already run (PROMOTE_PARTIAL)."""
    rows = files.join(signatures, "id", "left")
    is_code = C("extension").isin(*X.CODE)
    able = lambda c: F.coalesce(F.bool_or(is_code & C(c)), F.lit(False)).alias(c)
    g = rows.groupBy("parent_dir").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"), F.count_if(is_code).alias("code"), F.count_if(is_code & (F.size("fragments") > 0)).alias("fragmentary"), *[able(c) for c in X.CAPABILITIES])
    density = C("fragmentary") / F.greatest(F.lit(1), C("code"))
    chosen = g.where((C("files") >= 3) & (C("code") >= 2) & (density > 0.3) & (C("has_main") | C("has_cli") | C("has_api")))
    return chosen.select(F.lit("PROMOTE_PARTIAL").alias("kind"), C("parent_dir").alias("subject"), "files", "bytes", priority(C("files"), C("bytes"), F.lit(False), density, F.lit(0.0)).alias("priority"))


def repeated_functions(code: DataFrame, least: int = 3) -> DataFrame:
    """(name, files): functions of more than four characters defined in ``least`` files or more."""
    names = code.select("id", F.explode(F.array_distinct(T.all_matches(C("content"), X.FUNCTION_NAME))).alias("name")).where(F.length("name") > 4)
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("files")).where(C("files") >= least)


def shared_library(repeated: DataFrame) -> DataFrame:
    """One proposal if five functions or more are repeated (SHARED_LIBRARY)."""
    total = repeated.agg(F.count(F.lit(1)).alias("n"), F.sum("files").alias("files"))
    return total.where("n >= 5").select(F.lit("SHARED_LIBRARY").alias("kind"), F.lit("functions").alias("subject"), "files", F.lit(0).cast("long").alias("bytes"), F.least(F.lit(100.0), F.lit(40.0) + C("n") * 1.5).alias("priority"))


def orphaned_data(files: DataFrame) -> DataFrame:
    """Directories with a megabyte or more of data and no code (DATA_VIEWER)."""
    data = files.where(C("extension").isin(*X.DATA)).groupBy("parent_dir").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes")).where("bytes >= 1000000")
    bare = data.join(files.where(C("extension").isin(*X.CODE) & ~C("extension").isin(*X.DATA)).select("parent_dir"), "parent_dir", "left_anti")
    return bare.select(F.lit("DATA_VIEWER").alias("kind"), C("parent_dir").alias("subject"), "files", "bytes", priority(C("files"), C("bytes"), F.lit(False), F.lit(0.0), F.lit(1.0)).alias("priority"))


def large_scripts(files: DataFrame, signatures: DataFrame, least_bytes: int = 15_000) -> DataFrame:
    """Scripts that have grown into programs (PROMOTE_SCRIPT)."""
    rows = files.where(C("extension").isin(".py", ".js", ".ts", ".ps1") & (C("size_bytes") > least_bytes)).join(signatures, "id")
    able = sum((C(c).cast("int") for c in X.CAPABILITIES), F.lit(0))
    functions, classes = F.size(F.array_distinct("functions")), F.size(F.array_distinct("classes"))
    chosen = rows.where((able >= 3) | ((functions >= 15) & (classes >= 2)))
    return chosen.select(F.lit("PROMOTE_SCRIPT").alias("kind"), C("path").alias("subject"), F.lit(1).cast("long").alias("files"), C("size_bytes").alias("bytes"), F.least(F.lit(100.0), F.round(F.lit(35.0) + functions * 0.8 + able * 5.0 + 1e-9, 1)).alias("priority"))


def incomplete_projects(files: DataFrame, most: int = 100) -> DataFrame:
    """(dir, project, found, total, pct): directories that hold a part of the files of a kind of project, the first kind that fits.

    Each file says which patterns of which kinds it meets, for its directory or, for a pattern with a folder, for the one
    above; directories are never crossed with patterns.
    """
    order = {kind: i for i, kind in enumerate(X.PROJECTS)}
    name, parent = C("filename"), C("parent_dir")
    above = F.regexp_extract(parent, r"^(.*)[/\\]([^/\\]+)$", 1)
    own = F.regexp_extract(parent, r"^(.*)[/\\]([^/\\]+)$", 2)
    met = []
    for kind, patterns in X.PROJECTS.items():
        for p in patterns:
            folder, _, leaf = p.rpartition("/")
            hit = name.endswith(leaf[1:]) if leaf.startswith("*") else name == leaf
            if folder:
                hit = hit & (own == folder)
            met.append(F.when(hit, F.struct((above if folder else parent).alias("dir"), F.lit(order[kind]).alias("k"), F.lit(p).alias("pattern"))))
    found = files.select(F.inline(F.array_compact(F.array(*met)))).distinct().groupBy("dir", "k").agg(F.count(F.lit(1)).alias("found"))
    total = F.element_at(F.array(*[F.lit(len(p)) for p in X.PROJECTS.values()]), C("k") + 1)
    large = files.groupBy(parent.alias("dir")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("dir")
    part = found.join(large, "dir", "left_semi").withColumn("total", total).withColumn("pct", F.round(C("found") / C("total") * 100 + 1e-9, 1)).where("found < total and pct < 90")
    first = part.groupBy("dir").agg(F.min(F.struct("k", "found", "total", "pct")).alias("m")).select("dir", "m.*")
    project = F.element_at(F.array(*map(F.lit, X.PROJECTS)), C("k") + 1)
    return first.orderBy(F.desc("pct"), "dir").limit(most).select("dir", project.alias("project"), "found", "total", "pct")


def domain_summaries(scores: DataFrame, each: int = 5) -> DataFrame:
    """The ``each`` best files of every domain."""
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc_nulls_last("overall_score"), "file_id"))
    return scores.withColumn("place", place).where(C("place") <= each).select("domain", C("place").cast("int").alias("place"), "file_id", "overall_score")


def suggestions(stats: DataFrame, incomplete: DataFrame, files: DataFrame, most: int = 20) -> DataFrame:
    """(subject, reason, priority, weight): domains with many files (dashboard) or good ones without an engine (engine), kinds of
    project that are often unfinished, and many files with open tasks (debt). stats: domain, file_count, mean_quality.
    """
    subject, weight = C("domain").alias("subject"), C("file_count").alias("weight")
    large = stats.where((C("file_count") > 50) & ~C("domain").isin("PROG", "UNKNOWN")).select(subject, F.lit("dashboard").alias("reason"), F.when(C("file_count") > 200, "high").otherwise("medium").alias("priority"), weight)
    good = stats.where((C("mean_quality") > X.GOOD_QUALITY) & ~C("domain").isin(*X.ENGINE_TIERS)).select(subject, F.lit("engine").alias("reason"), F.lit("medium").alias("priority"), weight)
    unfinished = incomplete.groupBy(C("project").alias("subject")).agg(F.count(F.lit(1)).alias("weight")).where("weight >= 3").select("subject", F.lit("unfinished").alias("reason"), F.lit("low").alias("priority"), "weight")
    debt = files.where(T.has(C("content_sample"), X.OPEN_TASK)).agg(F.count(F.lit(1)).alias("weight")).where("weight > 20").select(F.lit("PROG").alias("subject"), F.lit("debt").alias("reason"), F.lit("medium").alias("priority"), "weight")
    out = large.unionByName(good).unionByName(unfinished).unionByName(debt)
    rank = F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), C("priority"))
    return out.orderBy(rank, F.desc("weight"), "subject", "reason").limit(most)


def all_proposals(files: DataFrame, domains: DataFrame, signatures: DataFrame, repeated: DataFrame) -> DataFrame:
    """(kind, subject, files, bytes, priority): everything that could be built or completed. domains: (id, domain); repeated: (name, files) of functions."""
    out = domain_proposals(files, domains)
    for part in (partial_projects(files, signatures), shared_library(repeated), orphaned_data(files), large_scripts(files, signatures)):
        out = out.unionByName(part)
    return out
