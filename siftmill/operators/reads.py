"""Reads over the tables of a corpus: latest rows, filters with paging, joins, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

DIMENSIONS = ("overall_score", "quality_score", "importance_score", "sensitivity_score", "staleness_score", "uniqueness_score", "risk_score")
TERMINAL = ("completed", "completed_with_warnings", "degraded", "failed", "cancelled")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of one key the one with the greatest ``order``, nulls last; combined before the shuffle, no window."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(*order, *[c for c in rest if c not in order])
    return rows.groupBy(*keys).agg(F.max(packed).alias("__m")).select(*keys, *[C(f"__m.{c}").alias(c) for c in rest])


def current_scores(scores: DataFrame) -> DataFrame:
    """The latest score of every file. NaN counts as missing."""
    clean = scores.select(*[F.when(~F.isnan(c), C(c)).alias(c) if c in DIMENSIONS else C(c) for c in scores.columns])
    return latest(clean, ["file_id"], ["scored_at", "id"])


def where_all(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows that equal every value that is given; a value of None asks for nothing."""
    wanted = [C(c) == v for c, v in equal.items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, wanted)) if wanted else rows


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def histogram(scores: DataFrame, dimension: str, buckets: int = 20) -> DataFrame:
    """(bucket_start, bucket_end, count) of a dimension over 0 to 100; 100 itself begins a bucket of its own."""
    if dimension not in DIMENSIONS:
        dimension = DIMENSIONS[0]
    width = 100.0 / buckets
    at = F.floor(C(dimension) / width)
    return scores.where(C(dimension).isNotNull()).groupBy((at * F.lit(width)).alias("bucket_start")).agg(F.count(F.lit(1)).alias("count")).select("bucket_start", (C("bucket_start") + width).alias("bucket_end"), "count")


def search(files: DataFrame, scores: DataFrame, text: str, limit: int) -> DataFrame:
    """Files whose name, path or sample holds a text in any letter case, the best overall score first."""
    hit = C("filename").ilike(f"%{text}%") | C("path").ilike(f"%{text}%") | C("content_sample").ilike(f"%{text}%")
    found = files.where(hit).select("id", "filename").join(scores.select(C("file_id").alias("id"), "overall_score", "primary_domain"), "id", "left")
    return page(found, [F.coalesce("overall_score", F.lit(0.0)).desc(), C("id").asc()], limit)


def unclassified(files: DataFrame, classifications: DataFrame) -> DataFrame:
    return files.join(classifications.select(C("file_id").alias("id")), "id", "left_anti")


def file_details(files: DataFrame, scores: DataFrame, classifications: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with their score and the numbers of their classifications and edges of duplicates."""
    n = lambda rows, key, name: rows.groupBy(C(key).alias("id")).agg(F.count(F.lit(1)).alias(name))
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    out = files.select("id", "filename", "size_bytes").join(scores.select(C("file_id").alias("id"), "overall_score", "risk_score"), "id", "left")
    out = out.join(n(classifications, "file_id", "classifications"), "id", "left").join(n(ends, "id", "duplicate_edges"), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("classifications", "duplicate_edges")})
