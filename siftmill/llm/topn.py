"""Top N rows of every group by descending score bands.

The score range is cut into bands at quantiles of the scores and the rows are stored by band, so each band is read alone.
Bands are processed from the top: rows of groups that are already full are removed by an anti-join, the rest is ranked
within the band (offset by what the group has already) and cut at N. A band is ranked exactly, ties included, so the band
edges never influence the result.

Hot groups: the ranking window carries a row-number limit, so each task keeps at most N rows of a group before the
exchange. A group with a third of all rows sends N rows per task, never the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: A set of full groups is broadcast up to this many groups, to the rows of a band before they are ranked; a larger set meets
#: the ranked rows, at most N of each group, where these are after their exchange by group.
BROADCAST_GROUPS = 50_000
#: Share of the rows in the bands from the top; what is left is the last band.
BAND_SHARES = (0.01, 0.1)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row for each key: that with the greatest ``order``. Repeated rows count once; nulls in ``order`` come last.

    The aggregate combines before the shuffle, so a hot key costs one row per task.
    """
    packed = F.struct(*[F.col(c) for c in [*order, *[k for k in keep if k not in order]]])
    out = df.groupBy(*keys).agg(F.max(packed).alias("__m"))
    return out.select(*keys, *[F.col(f"__m.{c}").alias(c) for c in keep])


def top_n(
    df: DataFrame,
    group: str,
    score: str,
    ties: Sequence[str],
    n: int,
    rank: str = "rank",
    band_shares: Sequence[float] = BAND_SHARES,
    broadcast_groups: int = BROADCAST_GROUPS,
    edges_of: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` rows with the highest ``score`` of every ``group``, ranked from 1 by score descending, then ``ties`` ascending.

    edges_of: a table with the same scores or nearly so, where that is cheaper to read than ``df``; the edges of the bands
    never influence the result.

    Defined cases: a null or NaN score takes no part; a null group is a group of its own; rows equal in group, score
    and all ties (repeated rows) are ranked one after the other and come out as often as they came in, up to ``n``;
    an empty table gives an empty result; a column called ``rank`` in the input is replaced, other columns are kept.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    df = df.drop(rank)
    columns = df.columns
    value = F.col(score).cast("double")
    usable = F.col(score).isNotNull() & ~F.isnan(value)
    # the edges come from the scores alone, before anything is stored
    scores = (df if edges_of is None else edges_of).where(usable)
    edges = scores.agg(F.percentile_approx(value, [1 - s for s in band_shares], 1000).alias("e")).first()["e"] if band_shares else []
    edges = sorted(set(edges or []), reverse=True)
    number = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        number = F.when(value >= edge, F.lit(i)).otherwise(number)
    rows = stored(df.where(usable).withColumn("__band", number), "topn-rows", ["__band"])

    best = Window.partitionBy(group).orderBy(F.col(score).desc(), *[F.col(t).asc() for t in ties])
    taken: DataFrame | None = None
    for i in range(len(edges) + 1):
        band = rows.where(F.col("__band") == i).select(*columns)
        place = F.row_number().over(best)
        if taken is None:
            cut = band.withColumn(rank, place).where(F.col(rank) <= n)
        else:
            counts = taken.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).cast("int").alias("__have"))
            full = counts.where(F.col("__have") >= n).select("__g")
            same: Column = F.col(group).eqNullSafe(F.col("__g"))
            if full.limit(broadcast_groups + 1).count() <= broadcast_groups:
                ranked = band.join(F.broadcast(full), same, "left_anti").withColumn(rank, place).where(F.col(rank) <= n)
            else:
                # the rank in the condition keeps the optimizer from moving the join below the ranking, to all rows of hot groups
                ranked = band.withColumn(rank, place).where(F.col(rank) <= n).join(full, same & (F.col(rank) > 0), "left_anti")
            cut = (
                ranked.join(counts, same, "left")
                .withColumn(rank, F.col(rank) + F.coalesce("__have", F.lit(0)))
                .where(F.col(rank) <= n)
                .select(*columns, rank)
            )
        cut = stored(cut.select(*columns, F.col(rank).cast("int").alias(rank)), "topn-band")
        taken = cut if taken is None else taken.unionByName(cut)
    return taken
