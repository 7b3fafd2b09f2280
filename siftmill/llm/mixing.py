"""Mixing sources to target weights by fitting budgets as subset sums.

1. Documents are counted by (source, exact length).
2. Budgets: a source gets its weight times a common level, at most its tokens times its repeats; the level is raised
   until the budgets add up to the total (sources at their cap stay there, the others keep their proportions).
3. A budget is some full passes over the source and a rest. The rest is spread over the lengths in proportion to their
   tokens, however few documents a length has; what remains is fitted by a bounded knapsack over the lengths and counts
   left, and where that leaves a gap, again with more left to the knapsack, in the end with documents given back. So a
   source reaches its budget to the token wherever its lengths allow that at all, whether they are short or long.
4. Of each length, the chosen number of documents is taken in the order of a seeded hash.

Only counts by length meet in one task, never documents: a source of T tokens has at most sqrt(2 T) different lengths
(their sum alone is T then), some millions for any corpus there is. Ranks within a length are taken within hash buckets
of some thousand rows, so a length that a third of all documents have isn't one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Tokens left for the knapsack where longer documents allow that.
KNAPSACK = 16_384
#: Documents of mean length that are left to the knapsack, then more where it leaves a gap.
LEFT = (2, 16, 128)
#: Sums that a knapsack tells apart; larger budgets are fitted in units of several tokens, rounded up.
SUMS = 1 << 20
#: Rows of one length that are ranked together, on average.
RANKED = 10_000
#: Sources that a table of weights may list.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Budget:
    source: str
    weight: float
    max_repeats: int
    available: int
    tokens: int

    @property
    def passes(self) -> int:
        return min(self.max_repeats, self.tokens // self.available) if self.available else 0

    @property
    def rest(self) -> int:
        return self.tokens - self.passes * self.available if self.available and self.passes < self.max_repeats else 0


def budgets(sources: Sequence[tuple[str, float, int, int]], total: int) -> list[Budget]:
    """Budgets of (source, weight, max_repeats, available tokens): weight times a common level, capped, adding up to ``total`` if the caps allow."""
    caps = [repeats * available for _, _, repeats, available in sources]
    weights = [w for _, w, _, _ in sources]
    given = [0.0] * len(sources)
    open_ = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    left = float(min(total, sum(caps[i] for i in open_)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * level >= caps[i]]
        if not full:
            for i in open_:
                given[i] = weights[i] * level
            break
        for i in full:
            given[i] = float(caps[i])
            left -= caps[i]
        open_ = [i for i in open_ if i not in full]
    whole = [min(caps[i], math.floor(g)) for i, g in enumerate(given)]
    short = round(min(total, sum(given))) - sum(whole)
    for i in sorted(range(len(sources)), key=lambda i: (whole[i] - given[i], i))[: max(0, short)]:
        whole[i] = min(caps[i], whole[i] + 1)
    return [Budget(s, w, r, a, whole[i]) for i, (s, w, r, a) in enumerate(sources)]


def common_total(sources: Sequence[tuple[str, float, int, int]], met: float) -> int:
    """The size of the largest mixture in which sources with ``met`` of all weight get exactly their weight times one level.

    A source's level is its cap by its weight. The sources of the lowest levels, with at most 1 - ``met`` of the weight, give
    all they have; so a few tiny sources don't shrink the mixture.
    """
    able = sorted((repeats * available / w, w, repeats * available) for _, w, repeats, available in sources if w > 0 and repeats * available > 0)
    if not able:
        return 0
    weight, below, level = sum(w for _, w, _ in able), 0.0, able[-1][0]
    for at, w, _ in able:
        below += w
        if below > (1.0 - met) * weight + 1e-9:
            level = at
            break
    return math.floor(sum(min(cap, w * level) for _, w, cap in able))


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take for the greatest sum not above ``budget``: bounded knapsack, counts split by powers of two.

    Of every sum only the step that first reached it is kept, so memory is that of the sums, whatever the number of lengths.
    """
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    unit = math.gcd(*lengths) if lengths else 1
    if budget // unit > SUMS:
        unit = -(-budget // SUMS)
    room, sizes = budget // unit, [-(-length // unit) for length in lengths]
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    first = np.full(room + 1, -1, np.int32)
    steps: list[tuple[int, int]] = []  # position, how many
    top = 0  # the greatest sum reached
    for i, (size, count) in enumerate(zip(sizes, counts)):
        power, count = 1, min(count, room // size if size else 0)
        while count > 0:
            many = min(power, count)
            move = many * size
            end = min(room, top + move) + 1
            fresh = reached[: end - move] & ~reached[move:end]
            if fresh.any():
                first[move:end][fresh] = len(steps)
                reached[move:end] |= fresh
                steps.append((i, many))
                top = max(top, move + int(np.flatnonzero(fresh)[-1]))
            count -= many
            power *= 2
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, many = steps[first[at]]
        taken[i] += many
        at -= many * sizes[i]
    return taken


def proportional(lengths: np.ndarray, counts: np.ndarray, order: np.ndarray, budget: int, total: int) -> np.ndarray:
    """How many documents of each length make up ``budget`` or less, so that long and short ones have the same share of it as of the source.

    From the longest on, each length takes what all lengths so far are short of their share; so lengths of one document take
    turns, and none is left out for having less than a whole document due.
    """
    take, seen, used, room = np.zeros_like(counts), 0, 0, max(0, budget)
    sizes, numbers = lengths.tolist(), counts.tolist()
    for i in order.tolist():
        seen += sizes[i] * numbers[i]
        if (many := min(numbers[i], (seen * room // total - used) // sizes[i])) > 0:
            take[i] = many
            used += many * sizes[i]
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to ``budget`` or as little less as can be found."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    order = np.argsort(-lengths, kind="stable")
    mean, take, left = -(-total // int(counts.sum())), None, 0
    for many in LEFT:
        again = proportional(lengths, counts, order, budget - min(KNAPSACK, many * mean), total)
        gap = budget - int((lengths * again).sum())
        for most in (1, None):  # one more of each length, then as many as there are
            for i in order:
                more = min(int(counts[i] - again[i]), (gap - KNAPSACK) // int(lengths[i]), most or budget)
                if more > 0:
                    again[i] += more
                    gap -= more * int(lengths[i])
        gap -= _fitted(lengths, counts, again, order, gap)
        if take is None or gap < left:
            take, left = again, gap
        if not left or many * mean >= min(KNAPSACK, budget):
            break
    for most in (2, budget):  # give back some of the longest, then all that there is room for, and fit anew
        if not left:
            break
        given, room = np.zeros_like(take), max(SUMS, 4 * int(lengths.max())) - left
        for i in order:
            many = min(int(take[i]), most, room // int(lengths[i]))
            if many > 0:
                given[i] = many
                room -= many * int(lengths[i])
        again, free = take - given, left + int((lengths * given).sum())
        if (gap := free - _fitted(lengths, counts, again, order, free)) < left:
            take, left = again, gap
    return take


def nearest_fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """``fit``, or the least sum above the budget where that is nearer: what is left out is fitted then."""
    take = fit(lengths, counts, budget)
    below, total = budget - int((lengths * take).sum()), int((lengths * counts).sum())
    if below <= 0 or budget >= total:
        return take
    above = counts - fit(lengths, counts, total - budget)
    return above if int((lengths * above).sum()) - budget < below else take


def _fitted(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, order: np.ndarray, left: int) -> int:
    """Fit ``left`` by knapsacks until nothing more is found, add what they take to ``take`` and return its tokens."""
    added = 0
    while True:
        fitting = [int(i) for i in order if lengths[i] <= left - added and take[i] < counts[i]]
        more = 0
        for i, many in zip(fitting, knapsack([int(lengths[i]) for i in fitting], [int(counts[i] - take[i]) for i in fitting], left - added)):
            take[i] += many
            more += many * int(lengths[i])
        if not more:
            return added
        added += more


def listed_sources(weights: DataFrame, source: str = "source") -> DataFrame:
    """``weights`` marked for a broadcast; a table of more than ``MOST_SOURCES`` rows raises an error."""
    if weights.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are listed")
    return F.broadcast(weights.where(F.col(source).isNotNull()))


def mix(
    sized: DataFrame,
    weights: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "n_tokens",
    weight: str = "target_weight",
    max_repeats: str = "max_repeats",
    total: int | None = None,
    met: float = 1.0,
    seed: int = 0,
    nearest: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, size, copies) and its report by source.

    A source of few texts may not reach its budget in whole texts: it comes as near as it can, above it too, or stays below
    it if ``nearest`` is false. The report gives target and actual shares, the ``reachable_share`` (the target among the sources that have tokens and
    may be used) and ``deviation``, the actual share less the reachable one.
    ``sized`` has one row for each text that may be used; ``total`` defaults to the most
    tokens at which sources with ``met`` of the weight keep their proportions exactly (1: all sources that have tokens do;
    less gives a larger mixture in which the smallest sources miss their shares).
    Defined cases: rows of sources that aren't listed, of null source, or of null or zero size take no part; a listed
    source without rows or with a null weight is reported with nothing; a source listed twice raises an error; equal
    hashes are ordered by key; an empty table gives an empty mixture; other columns don't matter.
    """
    spark = sized.sparkSession
    listed = listed_sources(weights.select(F.col(source).alias("source"), F.col(weight).cast("double").alias("weight"), F.col(max_repeats).cast("int").alias("repeats")))
    wanted = listed.collect()
    if len({r["source"] for r in wanted}) < len(wanted):
        raise ValueError("a source is listed twice")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("key")), 11) / F.lit(float(1 << 53))
    docs = stored(
        sized.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).cast("long").alias("size")).where("size > 0").join(listed.select("source"), "source", "left_semi").withColumn("u", unit),
        "mix-sizes",
    )
    counts = docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sums = {r["source"]: int(r["t"]) for r in counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("t")).collect()}
    sources = [(r["source"], max(0.0, r["weight"] or 0.0), max(0, r["repeats"] or 0), sums.get(r["source"], 0)) for r in wanted]
    plan = budgets(sources, common_total(sources, met) if total is None else total)

    able = sum(b.weight for b in plan if b.max_repeats * b.available > 0)
    rows = [(b.source, b.weight, b.max_repeats, b.available, b.tokens, b.passes, b.rest, b.weight / able if able and b.max_repeats * b.available > 0 else 0.0) for b in plan]
    budget = F.broadcast(spark.createDataFrame(rows, "source string, weight double, repeats int, available long, budget long, passes int, rest long, reachable double"))
    rest, fitting = {b.source: b.rest for b in plan}, nearest_fit if nearest else fit

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        return pdf.assign(take=fitting(pdf["size"].to_numpy(), pdf["n"].to_numpy(), rest[pdf["source"].iat[0]]))

    takes = counts.groupBy("source").applyInPandas(take, "source string, size long, n long, take long")
    takes = stored(takes.where("take > 0"), "mix-takes")
    cut = docs.join(takes, ["source", "size"]).withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("n") / RANKED)))
    lower = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.where(F.col("n") > RANKED).groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(lower), F.lit(0))).drop("m")
    cut = cut.join(before, ["source", "size", "bucket"], "left")
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("u", "key")) + F.coalesce("before", F.lit(0))
    chosen = cut.withColumn("place", place).where(F.col("place") <= F.col("take")).select("key", F.lit(1).alias("extra"))
    mixed = stored(
        docs.join(budget, "source").join(chosen, "key", "left").withColumn("copies", (F.col("passes") + F.coalesce("extra", F.lit(0))).cast("int")).where("copies > 0").select(F.col("key").alias(key), F.col("source").alias(source), F.col("size").alias(size), "copies"),
        "mix",
    )
    used = mixed.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(size) * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    everything = sum(int(r["tokens"]) for r in used.select("tokens").collect())
    share = F.coalesce("tokens", F.lit(0)) / F.lit(float(max(1, everything)))
    report = (
        budget.hint("broadcast")
        .join(used, "source", "left")
        .select(
            F.col("source").alias(source),
            F.col("weight").alias(weight),
            F.col("repeats").alias(max_repeats),
            F.col("available").alias("available_tokens"),
            F.col("budget").alias("budget_tokens"),
            F.coalesce("tokens", F.lit(0)).alias("actual_tokens"),
            F.coalesce("texts", F.lit(0)).alias("texts"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            share.alias("actual_share"),
            F.col("reachable").alias("reachable_share"),
            (share - F.col("reachable")).alias("deviation"),
        )
    )
    return mixed, report
