"""Classification from local evidence and from the answers of engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as P

C = F.col


def local_classification(files: DataFrame) -> DataFrame:
    """A deterministic classification of each file (with its ``keywords``) from extension, type, path and words.

    Missing domains are UNKNOWN, missing confidences 0; the hash covers all evidence, so equal evidence has equal hashes.
    """
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(C("domain_confidence"), F.lit(0.0))))
    domain = F.coalesce(C("detected_domain"), F.lit("UNKNOWN"))
    text = lambda c: F.coalesce(C(c), F.lit(""))
    evidence = F.concat_ws("|", text("path"), text("extension"), text("mime_type"), domain, F.format_string("%.6f", sure), F.array_join(F.array_sort(F.slice("keywords", 1, 20)), ","))
    return files.select(
        C("id").alias("file_id"),
        domain.alias("domain"),
        F.when(sure >= 0.8, "DEFENSIBLE").when(sure >= 0.5, "AGGRESSIVE").otherwise("UNKNOWN").alias("confidence"),
        sure.alias("score"),
        F.coalesce(F.nullif(C("extension"), F.lit("")), C("mime_type")).alias("topic"),
        F.lit(25).alias("authority_weight"),
        F.lit("LOCAL_RULES_V1").alias("engine_id"),
        P.tier(C("extension"), C("detected_domain"), C("domain_confidence"), C("size_bytes"), C("is_binary") == 1, C("content_sample")).alias("tier"),
        F.sha2(evidence, 256).alias("determinism_hash"),
    )


def best_of_domains(answers: DataFrame, domains: int, each: int) -> DataFrame:
    """Of every file's classifications those of its ``domains`` domains with the highest summed score, ``each`` per domain.

    Sums are decimal, so that their order doesn't matter; ties go by domain and id.
    """
    sums = answers.groupBy("file_id", "domain").agg(F.sum(C("score").cast("decimal(20,6)")).alias("total"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("total"), "domain"))
    top = sums.withColumn("domain_rank", place).where(C("domain_rank") <= domains)
    within = F.row_number().over(Window.partitionBy("file_id", "domain").orderBy(F.desc("score"), "id"))
    return answers.join(top, ["file_id", "domain"]).withColumn("rank", within).where(C("rank") <= each)


def with_fallback(files: DataFrame, answers: DataFrame, local: DataFrame) -> DataFrame:
    """Domain and score of every file: the best answer of an engine, else the local classification."""
    best = answers.groupBy("file_id").agg(F.max(F.struct(C("score"), (-C("id")).alias("o"), C("domain"), C("engine_id"))).alias("b"))
    joined = files.select(C("id").alias("file_id")).join(best, "file_id", "left").join(local.select("file_id", C("domain").alias("d"), C("score").alias("s"), C("engine_id").alias("e")), "file_id", "left")
    return joined.select("file_id", F.coalesce("b.domain", "d").alias("domain"), F.coalesce("b.score", "s").alias("score"), F.coalesce("b.engine_id", "e").alias("engine_id"))
