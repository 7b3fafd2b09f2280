"""Scores of files on six dimensions and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import fixed as X
from ..functions import text as T
from ..session import spread

C = F.col
RECENCY = [(7, 100.0), (30, 80.0), (90, 60.0), (365, 40.0), (730, 20.0)]
AGE = [(7, 0.0), (30, 10.0), (90, 25.0), (365, 50.0), (730, 75.0)]


#: Added before rounding, so that a tie that binary fractions have just missed goes up wherever it is computed.
NUDGE = 1e-9


def clipped(c: Column) -> Column:
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c)) + NUDGE, 1)


def weighted(weights: dict[str, float], factors: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + factors[name] * F.lit(weight)
    return clipped(total)


def classification_facts(classifications: DataFrame) -> DataFrame:
    """What the scores need of a file's classifications, one row per file. Sums are decimal, so their order doesn't matter.

    Aggregated before any join and combined before the shuffle: a file with a third of all classifications is one row per task.
    """
    score = F.coalesce(C("score"), F.lit(0.0))
    return classifications.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("matches"),
        (F.sum(score.cast("decimal(20,6)")).cast("double") / F.count(F.lit(1))).alias("match_score"),
        F.max("authority_weight").alias("authority"),
        F.max(P.lookup(F.coalesce(C("domain"), F.lit("")), X.CRITICALITY, X.OTHER_CRITICALITY)).alias("criticality"),
        (F.sum(P.lookup(F.coalesce(C("domain"), F.lit("")), X.SENSITIVE_DOMAINS, 0)) * 0.5).alias("boost"),
        F.max(F.when(C("domain") == "CYBER", score)).alias("cyber"),
        F.max(F.struct(score.alias("s"), (-C("id")).alias("o"), C("domain"), C("engine_id"))).alias("best"),
    )


def copies(files: DataFrame) -> DataFrame:
    """(digest, copies) of every digest in two or more files."""
    return files.select(P.digest(C("sha256")).alias("digest")).where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def quality() -> Column:
    text = F.coalesce(C("content_sample"), F.lit(""))
    words = C("__words")
    distinct = F.size(F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w: F.lower(w))))
    structure = (
        F.when(T.has(text, r"(?m)^#{1,6}\s|^[A-Z][A-Z\s]{5,}$"), 30.0).otherwise(0.0)
        + F.when(F.size(F.split(text, "\n\n")) - 1 > 2, 25.0).otherwise(0.0)
        + F.when(T.has(text, r"(?m)^\s*[-*]\s|^\s*\d+\.\s"), 25.0).otherwise(0.0)
        + F.when(T.has(text, r"```|def\s|class\s|function\s|import\s"), 20.0).otherwise(0.0)
    )
    there = lambda c: F.coalesce(F.length(C(c)) > 0, F.lit(False))
    factors = {
        "length": F.when(C("size_bytes") > 0, F.least(F.lit(100.0), F.log10("size_bytes") / 5.0 * 100.0)).otherwise(0.0),
        "density": F.when(F.size(words) > 0, F.least(F.lit(100.0), distinct / F.size(words) * 200.0)).otherwise(0.0),
        "structure": structure,
        "matches": F.least(F.lit(100.0), C("matches") * 20.0),
        "match_score": F.least(F.lit(100.0), C("match_score")),
        "completeness": F.when(there("content_sample"), 30.0).otherwise(0.0) + F.when(there("sha256"), 20.0).otherwise(0.0) + F.when(C("matches") > 0, 30.0).otherwise(0.0) + F.when(there("mime_type"), 20.0).otherwise(0.0),
    }
    return weighted(X.QUALITY_WEIGHTS, factors)


def importance() -> Column:
    n = C("copies")
    factors = {
        "criticality": F.coalesce(C("criticality"), F.lit(X.NO_CRITICALITY)).cast("double"),
        "authority": F.least(F.lit(100.0), F.coalesce(C("authority"), F.lit(0)).cast("double")),
        "recency": P.ladder(C("days_accessed"), RECENCY, 5.0),
        "references": F.least(F.lit(100.0), C("references") * 15.0),
        "uniqueness": F.when(n == 0, 100.0).when(n == 1, 60.0).when(n <= 3, 35.0).otherwise(10.0),
        "depth": F.when(C("depth") <= 2, 100.0).when(C("depth") <= 4, 70.0).when(C("depth") <= 6, 40.0).otherwise(15.0),
    }
    return weighted(X.IMPORTANCE_WEIGHTS, factors)


def sensitivity() -> Column:
    text, name = F.coalesce(C("content_sample"), F.lit("")), F.lower(C("filename"))
    found = F.greatest(*[F.when(T.has(text, p), float(w)).otherwise(0.0) for p, w in X.SENSITIVE.values()]) + F.coalesce(C("boost"), F.lit(0.0))
    ext = F.lower(C("extension"))
    by_extension = F.when(ext.isin(*X.KEY_FILES), 90.0).when(ext.isin(*X.DUMP_FILES), 40.0).otherwise(0.0)
    by_name = F.when(T.has_any(name, X.SECRET_NAMES), 85.0).when(T.has_any(name, X.PERSONAL_NAMES), 80.0).otherwise(0.0)
    return clipped(F.greatest(found, by_extension, by_name))


def staleness() -> Column:
    base = P.ladder(C("days_modified"), AGE, 90.0)
    old = F.when((C("days_accessed") > 730) & (base > 50), F.least(F.lit(100.0), base + 10.0)).otherwise(base)
    return clipped(F.when((C("days_accessed") < 30) & (old > 50), old * 0.6).otherwise(old))


def uniqueness() -> Column:
    n = C("copies")
    return F.when(n <= 1, 100.0).when(n == 2, 50.0).when(n <= 5, 25.0).otherwise(F.round(F.greatest(F.lit(5.0), 100.0 / n), 1))


def risk() -> Column:
    ext, path, text = F.coalesce(F.lower(C("extension")), F.lit("")), F.lower(C("path")), F.lower(C("content_sample"))
    s, cyber = C("sensitivity"), C("cyber").isNotNull()
    runs = ext.isin(*X.EXECUTABLE)
    return clipped(
        F.when((s > 70) & ~P.in_encrypted_place(C("path")), 40.0).otherwise(0.0)
        + F.when(runs & T.has_any(path, ("temp", "tmp", "download", "appdata")), 60.0).when(runs & T.has_any(path, ("desktop", "public")), 40.0).otherwise(0.0)
        + F.when(cyber, F.least(F.lit(50.0), C("cyber"))).otherwise(0.0)
        + F.when((s > 50) & P.in_shared_place(C("path")), 30.0).otherwise(0.0)
        + F.when(ext.isin(".bat", ".cmd", ".vbs", ".ps1", ".hta") & ~cyber, 20.0).otherwise(0.0)
        + F.when(ext.isin(".env", ".cfg", ".ini", ".conf") & T.has_any(text, ("password",)), 35.0).otherwise(0.0)
    )


def overall() -> Column:
    total = F.lit(0.0)
    for name, weight in X.OVERALL_WEIGHTS.items():
        total = total + (F.lit(weight) * C(name) if weight >= 0 else F.lit(-weight) * (F.lit(100.0) - C(name)))
    return clipped(total)


def score_files(files: DataFrame, classifications: DataFrame, as_of: str, references: DataFrame | None = None) -> DataFrame:
    """All scores of every file. ``references``: (file_id, references) by other files, none where it isn't given.

    Missing values lower what depends on them, they never drop a file.
    """
    facts = spread(files, "id").withColumn("digest", P.digest(C("sha256"))).join(copies(files), "digest", "left").join(classification_facts(classifications).withColumnRenamed("file_id", "id"), "id", "left")
    if references is not None:
        facts = facts.join(references.select(C("file_id").alias("id"), "references"), "id", "left")
    else:
        facts = facts.withColumn("references", F.lit(0))
    now = F.lit(as_of).cast("timestamp")
    facts = (
        facts.withColumn("copies", F.coalesce("copies", F.lit(0)))
        .withColumn("references", F.coalesce("references", F.lit(0)))
        .withColumn("matches", F.coalesce("matches", F.lit(0)))
        .withColumn("match_score", F.coalesce("match_score", F.lit(0.0)))
        .withColumn("days_modified", P.days_since(C("modified_at"), now))
        .withColumn("days_accessed", P.days_since(C("accessed_at"), now))
        .withColumn("sensitivity", sensitivity())
        .withColumn("__words", T.words(F.coalesce(C("content_sample"), F.lit(""))))
        .select("*", quality().alias("quality"), importance().alias("importance"), staleness().alias("staleness"), uniqueness().alias("uniqueness"), risk().alias("risk"))
    )
    return facts.select(
        C("id").alias("file_id"), "quality", "importance", "sensitivity", "staleness", "uniqueness", "risk", overall().alias("overall"),
        F.coalesce("best.domain", F.lit("UNKNOWN")).alias("primary_domain"), F.coalesce("best.engine_id", F.lit("")).alias("primary_engine"), C("matches").alias("classification_count"),
    )


def domain_distribution(classifications: DataFrame) -> DataFrame:
    """(file_id, domain, score): the summed score of each domain of a file."""
    return classifications.groupBy("file_id", "domain").agg(F.sum(F.coalesce(C("score"), F.lit(0.0)).cast("decimal(20,6)")).cast("double").alias("score"))
