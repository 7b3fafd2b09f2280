"""Near-duplicate texts by DartMinHash signatures, banded joining and exact verification.

A text is a weighted set of word shingles. Darts are thrown into the regions of each element: a region has the area 1 in
the plane of weight and rank, the number of darts in it is Poisson distributed with mean 1, and all of that is hashed from
the element and the region, so equal elements throw equal darts in every text. Regions are a unit of weight by a unit of
rank, and below the weight 1 dyadic: half the weight by two of rank, and so on, so light sets take few regions too. A dart
counts if it lands inside the element's weight. Each coordinate of the signature keeps its earliest dart; ranks are worked
off in rounds until every coordinate has one, so a text costs about k ln k darts whatever its length and weight. Two
signatures agree in a coordinate with the probability of the weighted Jaccard similarity.

Texts with equal shingle sets are folded into one class before anything is joined: a group of copies that holds a
third of all rows is one signature row. Classes meet in bands (a join on the band's hash, split by adaptive skew handling),
meeting pairs are compared on all their shingles.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, spread, stored

WORD = "[a-z0-9_]+"
MASK48 = np.uint64((1 << 48) - 1)
#: Words whose hashes a Python worker keeps.
KNOWN_WORDS = 1_000_000
ROWS_AT_ONCE = 2_000
#: Ids of classes or of texts to compare that are broadcast to a scan; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of a band for up to so many texts, and the chance that a pair at the threshold meets in no band.
FEW_ROWS, FEW_TEXTS, MISSED = 4, 10_000_000, 1e-6


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64 bits in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_edges() -> np.ndarray:
    """Upper edges, in 64-bit hash space, of 0, 1, 2 … darts in a region of area 1."""
    p, total, edges, k = np.exp(-1.0), 0.0, [], 0
    while k < 18:
        total += p
        edges.append(min(total, 1.0) * 2.0**64)
        k += 1
        p /= k
    return np.array([min(e, 2.0**64 - 2049) for e in edges], dtype=np.float64).astype(np.uint64)


EDGES = poisson_edges()


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray | None, n_docs: int, k: int, seed: int = 1) -> np.ndarray:
    """DartMinHash signatures of ``n_docs`` weighted sets as an (n_docs, k) array of uint64: rank above, dart id below.

    doc, element: a row for each element of each set; weight: its positive weight, 1 if not given. A set without
    elements has the greatest value in all coordinates. Weights below 2^-``LEVELS`` are right but take longer.
    """
    with np.errstate(over="ignore"):
        element = mixed(element ^ mixed(np.array([seed], np.uint64)))
        if weight is None:
            inside, length = None, np.ones(len(doc))
            element = mixed(element)
        else:
            doc, element, inside, length = slabs(doc, element, weight)
        best = np.full(n_docs * k, np.iinfo(np.uint64).max, np.uint64)
        begin, end = 0.0, 1.0
        while len(doc):
            # the strips of rank that begin in this round, each of the area 1
            if weight is None:
                at, strip = np.arange(len(doc)), np.full(len(doc), int(begin))
            else:
                first, last = np.ceil(begin / length).astype(np.int64), np.ceil(end / length).astype(np.int64)
                strips = last - first
                at = np.repeat(np.arange(len(doc)), strips)
                strip = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips) + first[at]
            region = mixed(element[at] + (strip.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            darts = np.searchsorted(EDGES, region, side="right")
            owner = np.repeat(np.arange(len(at)), darts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mixed(region[owner] ^ (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8CB92BA72F3D8DD7))
            of = at[owner]
            if inside is not None:
                lands = (mixed(dart + np.uint64(7)) >> np.uint64(11)) * 2.0**-53 < inside[of]
                dart, of, owner = dart[lands], of[lands], owner[lands]
            spot = doc[of] * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            again = mixed(dart)
            rank = ((strip[owner] + (again >> np.uint64(40)) * 2.0**-24) * length[of]).astype(np.float32)
            np.minimum.at(best, spot, (rank.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (again & np.uint64(0xFFFFFFFF)))
            # a set can't change any more once all its coordinates are taken before the end of this round
            bound = np.uint64(np.float32(end).view(np.uint32)) << np.uint64(32)
            more = (best.reshape(n_docs, k) >= bound).any(axis=1)[doc]
            if not more.all():
                doc, element, length = doc[more], element[more], length[more]
                inside = None if inside is None else inside[more]
            begin, end = end, end + 1.0 if weight is None else end * 2.0
        return best.reshape(n_docs, k)


#: Dyadic levels of weight below 1.
LEVELS = 20


def slabs(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slabs of weight of each element: set, hash, the share of the slab that lies inside the weight, and its strips' length of rank.

    Above 1 slabs are one unit wide; below, they reach from 2^-(j + 1) to 2^-j, the last one from 0 to 2^-``LEVELS``.
    """
    units = np.maximum(np.ceil(weight) - 1, 0).astype(np.int64)
    n = units + LEVELS + 1
    row = np.repeat(np.arange(len(doc)), n)
    level = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    below = level <= LEVELS
    low = np.where(below, np.where(level == LEVELS, 0.0, 2.0 ** -(np.minimum(level, LEVELS) + 1.0)), level - LEVELS)
    wide = np.where(below, np.where(level == LEVELS, 2.0**-LEVELS, low), 1.0)
    inside = np.minimum(1.0, (weight[row] - low) / wide)
    keep = inside > 0
    row, level = row[keep], level[keep]
    return doc[row], mixed(element[row] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), inside[keep], 1.0 / wide[keep]


def banding(n: int, threshold: float) -> tuple[int, int]:
    """(bands, rows) for ``n`` texts: a band has one more row for each tenfold beyond ``FEW_TEXTS``, so that dissimilar texts of
    common phrases don't meet more often as there are more of them; the bands make up for it, so the chance to miss a pair at the threshold is ``MISSED`` at every size.
    """
    rows = FEW_ROWS + max(0, math.ceil(math.log10(max(n, 1) / FEW_TEXTS)))
    return math.ceil(math.log(MISSED) / math.log1p(-(threshold**rows))), rows


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[str], words: int, min_words: int, known: WordHashes, find) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text, 48-bit hash) of the distinct shingles of each text with at least ``min_words`` words."""
    counts, flat = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        found = find(text.lower()) if text else ()
        if len(found) >= max(min_words, words):
            counts[i] = len(found)
            flat.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    tokens = np.concatenate(flat)
    doc = np.repeat(np.arange(len(texts)), counts)
    n = len(tokens) - words + 1
    with np.errstate(over="ignore"):
        shingle = np.zeros(n, np.uint64)
        for j in range(words):
            shingle = mixed(shingle + tokens[j : j + n] + np.uint64(j))
    same = doc[:n] == doc[words - 1 :]
    key = np.unique((doc[:n][same].astype(np.uint64) << np.uint64(48)) | (shingle[same] & MASK48))
    return (key >> np.uint64(48)).astype(np.int64), key & MASK48


def _signed(words: int, min_words: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find, k = WordHashes(), re.compile(WORD).findall, bands * rows
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            doc, shingle = shingle_sets(batch.column(1).to_pylist(), words, min_words, known, find)
            present, start = np.unique(doc, return_index=True)
            if not len(present):
                continue
            local = np.searchsorted(present, doc)
            with np.errstate(over="ignore"):
                one = np.add.reduceat(mixed(shingle + np.uint64(11)), start)
                two = np.add.reduceat(mixed(shingle ^ np.uint64(0x5851F42D4C957F2D)), start)
                signature = dart_signatures(local, shingle, None, len(present), k).reshape(len(present), bands, rows)
                band = mixed(np.arange(1, bands + 1, dtype=np.uint64))[None, :].repeat(len(present), axis=0)
                for j in range(rows):
                    band = mixed(band + signature[:, :, j])
            ends = np.arange(0, (len(present) + 1) * bands, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(present)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(band.view(np.int64).ravel()))],
                names=["id", "one", "two", "bands"],
            )

    return run


def hashed_shingles(words: int):
    """The distinct hashed shingles of the words in ``w``, for the exact comparison."""
    at = F.sequence(F.lit(0), F.size("w") - words)
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(words)])))


def near_duplicates(df: DataFrame, id: str, text: str, threshold: float, words: int = 5, min_words: int = 5, bands: int | None = None, rows: int | None = None, unique_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, and the pairs of classes with Jaccard similarity of at least ``threshold``.

    Returns ``members`` (id, class_id: the smallest id with the same shingle set) and ``links`` (class_a < class_b,
    similarity). ``id`` must be a whole number. A pair at similarity s meets with probability 1 - (1 - s^rows)^bands;
    bands and rows are taken by ``banding`` unless given: 100 bands of 4 rows, 0.999999 at 0.6 and more above it, for up to
    ten million texts. Every meeting pair is compared on all shingles. unique_ids: no id has two texts, as the caller knows.

    Defined cases: null texts and texts of fewer than ``min_words`` words (or than one shingle) take no part; rows with
    a null id take no part; repeated rows are one member; of an id with several texts the one of the least hash counts;
    letter case and all characters but a-z, 0-9 and _ don't matter; long texts are taken whole; an empty table gives
    empty results; other columns don't matter.
    """
    spark = df.sparkSession
    shared_dir(spark)
    source = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    if not unique_ids:
        hashed = F.xxhash64("text")
        several = stored(source.groupBy("id").agg(F.min(hashed).alias("least"), F.max(hashed).alias("greatest")).where("least <> greatest").select("id", "least"), "neardup-several")
        if not several.isEmpty():
            source = source.join(several, "id", "left").where(F.col("least").isNull() | (hashed == F.col("least"))).select("id", "text")
    if bands is None or rows is None:
        bands, rows = banding(source.count(), threshold)
    signed = stored(spread(source, "id").mapInArrow(_signed(words, min_words, bands, rows), "id long, one long, two long, bands array<long>"), "neardup-signed")
    keys = signed.select("id", "one", "two")
    classes = stored(keys.groupBy("one", "two").agg(F.min("id").alias("class_id")), "neardup-classes")
    members = (keys if unique_ids else keys.distinct()).join(classes, ["one", "two"]).select("id", "class_id")

    # one row of each class has its bands
    of_classes = classes.select(F.col("class_id").alias("id"))
    if of_classes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        of_classes = F.broadcast(of_classes)
    firsts = signed.select("id", "bands").join(of_classes, "id", "left_semi")
    firsts = firsts if unique_ids else firsts.dropDuplicates(["id"])
    met = firsts.select(F.col("id").alias("class_id"), F.explode("bands").alias("band"))
    pairs = met.alias("a").join(met.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.class_id") < F.col("b.class_id")))
    pairs = stored(pairs.select(F.col("a.class_id").alias("class_a"), F.col("b.class_id").alias("class_b")).distinct(), "neardup-pairs")

    needed = stored(pairs.select(F.explode(F.array("class_a", "class_b")).alias("id")).distinct(), "neardup-needed")
    if needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))
    texts = source.join(needed, "id", "left_semi").dropDuplicates(["id"])
    sets = stored(texts.withColumn("w", found).select("id", hashed_shingles(words).alias("s")), "neardup-sets")
    both = F.size(F.array_intersect("sa", "sb"))
    links = (
        pairs.join(sets.select(F.col("id").alias("class_a"), F.col("s").alias("sa")), "class_a")
        .join(sets.select(F.col("id").alias("class_b"), F.col("s").alias("sb")), "class_b")
        .select("class_a", "class_b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    return members, links
