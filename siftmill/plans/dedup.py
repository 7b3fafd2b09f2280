"""Queries of duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import WHITE
from ..operators import dedup
from ..session import spread, table
from .catalog import query, s, s_normal
from .scores import s_digest

C = F.col

#: The latest score of each file, as strategies see it.
S_QUALITY = "SELECT file_id, first(quality_score ORDER BY scored_at DESC NULLS LAST, id DESC) AS quality, first(primary_domain ORDER BY scored_at DESC NULLS LAST, id DESC) AS primary_domain FROM intelligence_scores GROUP BY file_id"


def with_quality(spark, d, files=None):
    scores = table(spark, d, "intelligence_scores").groupBy("file_id").agg(F.max(F.struct("scored_at", "id", "quality_score", "primary_domain")).alias("m"))
    quality = F.when(~F.isnan("m.quality_score"), C("m.quality_score"))
    files = table(spark, d, "files") if files is None else files
    return spread(files, "id").join(scores.select(C("file_id").alias("id"), quality.alias("quality"), C("m.primary_domain").alias("primary_domain")), "id", "left")


ORDERS = {
    "keep_newest": "coalesce(modified_at, '') DESC, id",
    "keep_largest": "coalesce(size_bytes, -1) DESC, id",
    "keep_shallowest": "coalesce(depth, 2147483647), id",
    "keep_most_accessed": "coalesce(accessed_at, '') DESC, id",
    "keep_highest_quality": "quality DESC NULLS LAST, CASE WHEN quality IS NULL THEN coalesce(modified_at, '') END DESC, id",
    "keep_in_domain_folder": "there DESC, CASE WHEN there = 0 THEN quality END DESC NULLS LAST, CASE WHEN there = 0 AND quality IS NULL THEN coalesce(modified_at, '') END DESC, id",
}


def s_clusters(keyed: str, strategy: str, having: str = "") -> str:
    return f"""SELECT cluster, count(*) AS file_count, first(id ORDER BY {ORDERS[strategy]}) AS keeper_id, CAST(sum(coalesce(size_bytes, 0)) - first(coalesce(size_bytes, 0) ORDER BY {ORDERS[strategy]}) AS BIGINT) AS wasted_bytes
FROM ({keyed}) GROUP BY cluster HAVING count(*) > 1 {having}"""


S_EXACT = f"SELECT *, {s_digest('sha256')} AS cluster FROM files WHERE {s_digest('sha256')} IS NOT NULL"
S_RATED = f"""SELECT f.*, CASE WHEN NOT isnan(q.quality) THEN q.quality END AS quality, CAST(coalesce(length(q.primary_domain) > 0 AND contains(lower(f.path), lower(q.primary_domain)), false) AS INT) AS there, {s_digest('f.sha256')} AS cluster
FROM files f LEFT JOIN ({S_QUALITY}) q ON q.file_id = f.id WHERE {s_digest('f.sha256')} IS NOT NULL"""
S_NEAR = f"SELECT *, 'near:' || substring(sha256({s_normal('content_sample')}), 1, 32) AS cluster FROM files WHERE length(content_sample) > 0 AND coalesce(is_binary, 0) = 0"
S_DIFFERING = f"AND count(DISTINCT {s_digest('sha256')}) > 1"


@query("d1_exact_clusters", s_clusters(S_EXACT, "keep_newest"))
def d1_exact_clusters(spark, d):
    return dedup.clusters(dedup.exact_keys(table(spark, d, "files")))


@query("d1_exact_members", f"WITH k AS ({S_EXACT}), c AS ({s_clusters('SELECT * FROM k', 'keep_newest')}) SELECT k.cluster, k.id AS file_id, k.id = c.keeper_id AS is_keeper FROM k JOIN c ON c.cluster = k.cluster")
def d1_exact_members(spark, d):
    keyed = dedup.exact_keys(table(spark, d, "files"))
    return dedup.members(keyed, dedup.clusters(keyed))


@query("d2_near_clusters", s_clusters(S_NEAR, "keep_newest", S_DIFFERING))
def d2_near_clusters(spark, d):
    return dedup.clusters(dedup.near_keys(table(spark, d, "files")), differing=True)


def _keeper(strategy: str) -> None:
    @query(f"d4_{strategy}", f"SELECT cluster, keeper_id, wasted_bytes FROM ({s_clusters(S_RATED, strategy)})")
    def d4(spark, d):
        return dedup.clusters(dedup.exact_keys(with_quality(spark, d)), strategy).select("cluster", "keeper_id", "wasted_bytes")


for _strategy in dedup.STRATEGIES:
    _keeper(_strategy)

_S_KEYS = f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(content_sample, '')), {s(WHITE)}), lambda w: length(w) >= 3 AND regexp_matches(w, '^\\p{{L}}+$')))"
S_LINKS = f"""WITH b AS (SELECT file_id, concat_ws(':', first(domain ORDER BY coalesce(score, 0.0) DESC, id), first(topic ORDER BY coalesce(score, 0.0) DESC, id)) AS block FROM classifications GROUP BY file_id),
k AS (SELECT f.id, b.block, list_sort({_S_KEYS}) AS k FROM files f JOIN b ON b.file_id = f.id),
c AS (SELECT block, k, min(id) AS class_id FROM k WHERE len(k) > 0 GROUP BY block, k),
j AS (SELECT x.block, x.class_id AS class_a, y.class_id AS class_b, len(list_intersect(x.k, y.k)) AS i, len(x.k) + len(y.k) AS n FROM c x JOIN c y ON y.block = x.block AND x.class_id < y.class_id AND len(x.k) >= 0.8 * len(y.k) AND len(y.k) >= 0.8 * len(x.k))
SELECT block, class_a, class_b, i / CAST(n - i AS DOUBLE) AS similarity FROM j WHERE i / CAST(n - i AS DOUBLE) >= 0.8"""


@query("d3_semantic_links", S_LINKS)
def d3_semantic_links(spark, d):
    """Pairs of classes of equal keyword sets, within primary domain and topic, whose overlap is at least 0.8."""
    best = table(spark, d, "classifications").groupBy("file_id").agg(F.max(F.struct(F.coalesce(C("score"), F.lit(0.0)).alias("s"), (-C("id")).alias("o"), C("domain"), C("topic"))).alias("b"))
    docs = spread(table(spark, d, "files").select("id", "content_sample"), "id").join(best.select(C("file_id").alias("id"), F.concat_ws(":", "b.domain", "b.topic").alias("block")), "id").select("id", "block", T.keyword_set(F.coalesce(C("content_sample"), F.lit(""))).alias("k"))
    return dedup.overlap_links(docs, "block", "id", "k", 0.8)[1]


@query("d3_semantic_clusters")
def d3_semantic_clusters(spark, d):
    """Clusters around first seeds; taken one by one in the order of the ids, which SQL doesn't express."""
    return dedup.clusters(dedup.semantic_keys(table(spark, d, "files"), table(spark, d, "classifications")))


@query("d0_all_duplicates")
def d0_all_duplicates(spark, d):
    """Exact clusters, near ones among the rest, semantic ones among the rest of that."""
    return dedup.all_duplicates(with_quality(spark, d), table(spark, d, "classifications"), "keep_highest_quality")


@query("d5_duplicate_totals", f"SELECT count(*) AS clusters, CAST(sum(file_count) AS BIGINT) AS files, CAST(sum(file_count - 1) AS BIGINT) AS duplicates, CAST(sum(wasted_bytes) AS BIGINT) AS wasted_bytes FROM ({s_clusters(S_EXACT, 'keep_newest')})")
def d5_duplicate_totals(spark, d):
    found = dedup.clusters(dedup.exact_keys(table(spark, d, "files")))
    return found.agg(F.count(F.lit(1)).alias("clusters"), F.sum("file_count").alias("files"), F.sum(C("file_count") - 1).alias("duplicates"), F.sum("wasted_bytes").alias("wasted_bytes"))


@query("d0_all_members")
def d0_all_members(spark, d):
    """The files of exact, near and semantic clusters and which of them are kept."""
    return dedup.keyed_duplicates(with_quality(spark, d), table(spark, d, "classifications"), "keep_highest_quality")[1]
