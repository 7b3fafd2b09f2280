"""Clusters of exact, near and semantic duplicates, and which file of a cluster is kept."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import text as T
from ..session import spread, stored

C = F.col

#: Undecided nodes and links that one task decides at once.
AT_ONCE = 500_000
#: The most frequent words, whose order decides which words of a set are its prefix.
RANKED_WORDS = 100_000


# Strategies: what a file of a cluster is ordered by, greatest first; ties go to the smallest id.
def newest() -> list[Column]:
    return [F.coalesce(C("modified_at"), F.lit(""))]


def largest() -> list[Column]:
    return [F.coalesce(C("size_bytes"), F.lit(-1)).cast("long")]


def shallowest() -> list[Column]:
    return [-F.coalesce(C("depth"), F.lit(2**31 - 1)).cast("long")]


def most_accessed() -> list[Column]:
    return [F.coalesce(C("accessed_at"), F.lit(""))]


def highest_quality() -> list[Column]:
    """By quality where a file has a score; clusters without any score go by modification."""
    return [C("quality").isNotNull().cast("int"), F.coalesce(C("quality"), F.lit(-1.0)), F.when(C("quality").isNull(), F.coalesce(C("modified_at"), F.lit(""))).otherwise("")]


def in_domain_folder() -> list[Column]:
    """The first file whose path names its domain, else by quality."""
    there = F.coalesce(F.contains(F.lower(C("path")), F.lower(C("primary_domain"))) & (F.length("primary_domain") > 0), F.lit(False)).cast("int")
    return [there, *[F.when(there == 0, c) for c in highest_quality()]]


STRATEGIES: dict[str, Callable[[], list[Column]]] = {
    "keep_newest": newest, "keep_largest": largest, "keep_shallowest": shallowest, "keep_most_accessed": most_accessed, "keep_highest_quality": highest_quality, "keep_in_domain_folder": in_domain_folder,
}


def exact_keys(files: DataFrame) -> DataFrame:
    """Files with the digest they share with others."""
    return files.withColumn("cluster", P.digest(C("sha256"))).where("cluster is not null")


def near_keys(files: DataFrame) -> DataFrame:
    """Text files with the hash of their normalised sample."""
    text = files.where((F.length("content_sample") > 0) & (F.coalesce(C("is_binary"), F.lit(0)) == 0))
    return text.withColumn("cluster", F.concat(F.lit("near:"), F.substring(T.normalized_hash(C("content_sample")), 1, 32)))


def clusters(keyed: DataFrame, strategy: str = "keep_newest", differing: bool = False) -> DataFrame:
    """One row for each ``cluster`` of two or more files: file_count, keeper_id, wasted_bytes.

    One aggregation that combines before its shuffle, no window: a cluster of a third of all files is one row per task.
    ``differing``: only clusters whose files have more than one digest. Missing sizes count as none.
    """
    size = F.coalesce(C("size_bytes"), F.lit(0))
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(STRATEGIES[strategy]())], (-C("id")).alias("oid"))
    digest = P.digest(C("sha256"))
    out = keyed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum(size).alias("total"), F.max(F.struct(order.alias("o"), C("id"), size.alias("size"))).alias("keeper"), F.min(digest).alias("low"), F.max(digest).alias("high")
    )
    if differing:
        out = out.where("low < high")
    return out.where("file_count > 1").select("cluster", "file_count", C("keeper.id").alias("keeper_id"), (C("total") - C("keeper.size")).alias("wasted_bytes"))


def members(keyed: DataFrame, clustered: DataFrame) -> DataFrame:
    """(cluster, file_id, is_keeper) of every file in a cluster."""
    return keyed.select("cluster", C("id").alias("file_id")).join(clustered.select("cluster", "keeper_id"), "cluster").select("cluster", "file_id", (C("file_id") == C("keeper_id")).alias("is_keeper"))


# --- semantic duplicates ------------------------------------------------------------------------------------------------


def overlap_links(docs: DataFrame, block: str, id: str, keywords: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of keyword sets in one block with Jaccard similarity of at least ``threshold``, exactly.

    Equal sets of a block are one class (its smallest id). Classes meet in their prefixes: with words ordered from rare to
    frequent, two sets as similar as that share one of their first ``n - ceil(threshold * n) + 1`` words. The join is on
    (block, word), so neither a large block nor a frequent word makes a large group; what meets is compared in full.
    Returns classes (block, class_id, id) and links (class_a < class_b, similarity).
    """
    sets = docs.select(C(block).alias("block"), C(id).alias("id"), F.array_sort(C(keywords)).alias("k"))
    # stored once and filtered after that, as a filter before would split the texts a second time
    hashed = stored(sets.withColumn("h", F.xxhash64("block", "k")).withColumn("h2", F.md5(F.array_join("k", " "))), "overlap-sets").where(F.size("k") > 0)
    classes = stored(hashed.groupBy("block", "h", "h2").agg(F.min("id").alias("class_id"), F.first("k").alias("k")), "overlap-classes")
    member = hashed.select("block", "h", "h2", "id").join(classes.select("block", "h", "h2", "class_id"), ["block", "h", "h2"]).select("block", "class_id", "id")
    counted = classes.select(F.explode("k").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    # any order of all words is right, one from rare to frequent is fast; a bounded list of the frequent ones suffices for it
    frequent = [r["w"] for r in counted.where("f > 1").orderBy(F.desc("f"), "w").limit(RANKED_WORDS).collect()]
    prefix = classes.select("block", "class_id", F.size("k").alias("n"), F.explode(_prefix(classes.sparkSession, frequent, threshold)(C("k"))).alias("w"))
    a, b = (prefix.select(*[C(c).alias(f"{c}_{x}") for c in ("class_id", "n")], "block", "w") for x in "ab")
    met = a.join(b, ["block", "w"]).where((C("class_id_a") < C("class_id_b")) & (C("n_a") >= C("n_b") * threshold) & (C("n_b") >= C("n_a") * threshold))
    pairs = met.select("block", C("class_id_a").alias("class_a"), C("class_id_b").alias("class_b")).distinct()
    ka, kb = (classes.select("block", C("class_id").alias(f"class_{x}"), C("k").alias(f"k_{x}")) for x in "ab")
    links = pairs.join(ka, ["block", "class_a"]).join(kb, ["block", "class_b"]).select("block", "class_a", "class_b", T.jaccard(C("k_a"), C("k_b")).alias("similarity")).where(C("similarity") >= threshold)
    return member, stored(links, "overlap-links")


def _prefix(spark: SparkSession, frequent: list[str], threshold: float):
    """A column function: the first ``n - ceil(threshold * n) + 1`` of n words, those that aren't frequent first, then from rare to frequent."""
    ranks = spark.sparkContext.broadcast({w: -i for i, w in enumerate(frequent)})

    @F.arrow_udf("array<string>")
    def prefix(sets: pa.Array) -> pa.Array:
        place, lowest = ranks.value, -len(ranks.value)
        out = []
        for words in sets.to_pylist():
            kept = len(words) - math.ceil(threshold * len(words)) + 1
            out.append(sorted(words, key=lambda w: (place.get(w, lowest), w))[:kept])
        return pa.array(out, pa.list_(pa.string()))

    return prefix


def _in_order(links: list[tuple[int, int]], nodes: set[int]) -> list[tuple[int, int]]:
    """(node, seed) of all nodes, taken one by one in the order of their ids."""
    later: dict[int, list[int]] = {}
    for u, v in links:
        later.setdefault(u, []).append(v)
    seed_of: dict[int, int] = {}
    for n in sorted(nodes):
        if n not in seed_of:
            seed_of[n] = n
            for v in later.get(n, ()):
                seed_of.setdefault(v, n)
    return list(seed_of.items())


def first_stars_by_block(links: DataFrame, block: str, a: str, b: str, at_once: int = AT_ONCE) -> DataFrame:
    """``first_stars`` of links that lie within blocks: blocks of at most ``at_once`` links are decided in a task each, all at
    the same time; only larger ones go through rounds.
    """

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _in_order(list(zip(pdf["u"], pdf["v"])), {*pdf["u"], *pdf["v"]})
        return pd.DataFrame(found, columns=["node", "seed"], dtype="int64")

    rows = links.select(C(block).alias("block"), C(a).cast("long").alias("u"), C(b).cast("long").alias("v"))
    large = [r["block"] for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(C("n") > at_once).select("block").limit(LARGE_BLOCKS + 1).collect()]
    if not large:
        return rows.groupBy("block").applyInPandas(decide, "node long, seed long")
    if len(large) > LARGE_BLOCKS:
        return first_stars(rows, "u", "v")
    small = rows.where(~C("block").isin(large)).groupBy("block").applyInPandas(decide, "node long, seed long")
    return small.unionByName(first_stars(rows.where(C("block").isin(large)), "u", "v"))


#: Large blocks that are named in a condition; where there are more, all links go through rounds.
LARGE_BLOCKS = 1_000


def first_stars(links: DataFrame, a: str, b: str, rounds: int = 20) -> DataFrame:
    """(node, seed): every linked node goes to the first seed that it is linked to, in the order of the ids.

    A node is a seed unless an earlier seed is linked to it, as if nodes were taken one by one. Decided in rounds: a node
    without undecided earlier neighbours is a seed, later neighbours of seeds are taken. Every round decides at least the
    smallest node of each component; what is decided is written to the shared folder, so lineage doesn't grow. After ``rounds``
    a long chain's rest is decided node by node in one task as soon as it has at most ``AT_ONCE`` nodes and links.
    """

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _in_order(list(zip(pdf["u"], pdf["v"])), {*pdf["u"], *pdf["v"]})
        return pd.DataFrame({"n": [n for n, seed in found if n == seed]}, dtype=pdf["u"].dtype)

    edges = stored(links.select(C(a).alias("u"), C(b).alias("v")).distinct(), "stars-edges")  # u < v
    open_ = edges
    nodes = edges.select(C("u").alias("n")).union(edges.select(C("v").alias("n"))).distinct()
    seeds: DataFrame | None = None
    for turn in itertools.count(1):
        later = open_.select(C("v").alias("n")).distinct()
        fresh = stored(nodes.join(later, "n", "left_anti"), "stars-seeds")
        seeds = fresh if seeds is None else seeds.unionByName(fresh)
        taken = open_.join(fresh.withColumnRenamed("n", "u"), "u", "left_semi").select(C("v").alias("n")).distinct()
        nodes = stored(nodes.join(fresh, "n", "left_anti").join(taken, "n", "left_anti"), "stars-nodes")
        if nodes.isEmpty():
            break
        left = nodes.select(C("n").alias("u")), nodes.select(C("n").alias("v"))
        open_ = stored(open_.join(left[0], "u", "left_semi").join(left[1], "v", "left_semi"), "stars-open")
        if turn >= rounds:
            rest = open_.unionByName(nodes.select(C("n").alias("u"), C("n").alias("v")))
            if rest.limit(AT_ONCE + 1).count() <= AT_ONCE:
                seeds = seeds.unionByName(stored(rest.groupBy().applyInPandas(in_order, nodes.schema), "stars-seeds"))
                break
    to = edges.join(seeds.withColumnRenamed("n", "u"), "u", "left_semi").groupBy("v").agg(F.min("u").alias("seed"))
    taken = to.join(seeds.withColumnRenamed("n", "v"), "v", "left_anti").select(C("v").alias("node"), "seed")
    return taken.unionByName(seeds.select(C("n").alias("node"), C("n").alias("seed")))


def semantic_keys(files: DataFrame, classifications: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Files with their semantic cluster."""
    return files.join(semantic_seeds(files, classifications, threshold), "id")


def semantic_seeds(files: DataFrame, classifications: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, cluster) by the seed of the semantic cluster: same primary domain and topic, keyword overlap with the seed."""
    best = classifications.groupBy("file_id").agg(F.max(F.struct(F.coalesce(C("score"), F.lit(0.0)).alias("s"), (-C("id")).alias("o"), C("domain"), C("topic"))).alias("b"))
    block = F.concat_ws(":", "b.domain", "b.topic")
    docs = spread(files.select("id", "content_sample"), "id").join(best.select(C("file_id").alias("id"), block.alias("block")), "id").select("id", "block", T.keyword_set(F.coalesce(C("content_sample"), F.lit(""))).alias("k"))
    member, links = overlap_links(docs, "block", "id", "k", threshold)
    stars = first_stars_by_block(links, "block", "class_a", "class_b").select(C("node").alias("class_id"), "seed")
    return member.join(stars, "class_id", "left").select("id", F.concat(F.lit("sem:"), "block", F.lit(":"), F.coalesce("seed", "class_id").cast("string")).alias("cluster"))


def all_duplicates(files: DataFrame, classifications: DataFrame, strategy: str, threshold: float = 0.8) -> DataFrame:
    """(kind, cluster, file_count, keeper_id, wasted_bytes): exact, then near among the rest, then semantic among the rest."""
    return keyed_duplicates(files, classifications, strategy, threshold)[0]


#: Columns that strategies look at.
LOOKED_AT = ("id", "path", "sha256", "size_bytes", "modified_at", "accessed_at", "depth", "quality", "primary_domain")


def keyed_duplicates(files: DataFrame, classifications: DataFrame, strategy: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The clusters of ``all_duplicates`` and their members (kind, cluster, file_id, is_keeper).

    What the keys and strategies need is worked out in one pass and stored without the texts; only the semantic keys of what
    is left read these again.
    """
    text = (F.length("content_sample") > 0) & (F.coalesce(C("is_binary"), F.lit(0)) == 0)
    near_key = F.when(text, F.concat(F.lit("near:"), F.substring(T.normalized_hash(C("content_sample")), 1, 32)))
    facts = stored(spread(files, "id").select(*[c for c in LOOKED_AT if c in files.columns], P.digest(C("sha256")).alias("exact_key"), near_key.alias("near_key")), "dedup-facts")

    def without(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found.select(C("file_id").alias("id")), "id", "left_anti")

    keyed = facts.where("exact_key is not null").withColumn("cluster", C("exact_key"))
    exact = stored(clusters(keyed, strategy), "dedup-exact")
    in_exact = members(keyed, exact)
    rest = without(facts, in_exact)
    keyed = rest.where("near_key is not null").withColumn("cluster", C("near_key"))
    near = stored(clusters(keyed, strategy, differing=True), "dedup-near")
    in_near = members(keyed, near)
    rest = stored(without(rest, in_near), "dedup-rest")
    seeds = semantic_seeds(files.join(rest.select("id"), "id", "left_semi"), classifications, threshold)
    keyed = rest.join(seeds, "id")
    semantic = stored(clusters(keyed, strategy), "dedup-semantic")
    parts = [(kind, found.select(F.lit(kind).alias("kind"), "*"), inside.select(F.lit(kind).alias("kind"), "*")) for kind, found, inside in (("exact", exact, in_exact), ("near", near, in_near), ("semantic", semantic, members(keyed, semantic)))]
    return parts[0][1].unionByName(parts[1][1]).unionByName(parts[2][1]), parts[0][2].unionByName(parts[1][2]).unionByName(parts[2][2])
