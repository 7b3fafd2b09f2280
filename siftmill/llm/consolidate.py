"""One surviving record for each group of duplicates, chosen field by field.

The fields of every row are unpivoted to long rows (group, field, value, vote, order). A vote is the trust in the row's
source times a recency decay, in millionths, so sums don't depend on the order of addition. Votes are summed for each
normalised value of a field, the winner is taken by ``max_by`` and the winners are pivoted back to one row per group.

Both aggregates combine before their shuffle and the first one hashes on (group, field, value), so a group holding a
third of all rows is spread over all tasks and no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTE_UNIT = 1_000_000


@dataclass(frozen=True)
class Field:
    """How a field of the surviving record is chosen.

    value: what the winner contributes. norm: what counts as the same value (default: the value). vote: weight of a
    row (default 1). order: decides between values of equal votes, greatest first, all of them ``long``; its last entry
    should make it total. where: rows that may contribute (default: value is not null).
    """

    name: str
    value: Column
    order: Sequence[Column]
    norm: Column | None = None
    vote: Column | None = None
    where: Column | None = None
    type: str = "string"
    default: object = field(default=None)


def decayed(trust: Column, at: Column, as_of: Column, half_life_days: float) -> Column:
    """Trust times 2^(-age / half life); rows without an instant get the vote of one ten half-lives old."""
    age = (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86_400e6) / half_life_days
    return trust * F.pow(F.lit(0.5), F.when(age.isNull(), F.lit(10.0)).otherwise(F.least(F.greatest(age, F.lit(0.0)), F.lit(10.0))))


def consolidate(df: DataFrame, key: str, fields: Sequence[Field], min_rows: int = 2) -> DataFrame:
    """One row for each ``key`` with at least ``min_rows`` rows: the key, ``n_rows`` and one column per field.

    Defined cases: rows with a null key take no part; a field without a contributing row gets its default (null unless
    given); repeated rows vote repeatedly; equal votes and orders fall back to the greatest normalised value; an empty
    table gives no rows; other columns of ``df``, whatever their names, don't appear in the result.
    """
    width = max(len(f.order) for f in fields)
    pad = F.lit(0).cast("long")
    entries = []
    for f in fields:
        ok = f.value.isNotNull() if f.where is None else (f.where & f.value.isNotNull())
        norm = (f.value if f.norm is None else f.norm).cast("string")
        vote = F.round((F.lit(1.0) if f.vote is None else f.vote) * VOTE_UNIT).cast("long")
        order = [c.cast("long") for c in f.order] + [pad] * (width - len(f.order))
        entries.append(
            F.when(
                ok,
                F.struct(
                    F.lit(f.name).alias("field"),
                    F.coalesce(norm, F.lit("")).alias("norm"),
                    f.value.cast("string").alias("value"),
                    vote.alias("vote"),
                    F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("order"),
                ),
            )
        )
    # the row count is one more field, so that it needs no second pass
    entries.append(F.struct(F.lit("").alias("field"), F.lit("").alias("norm"), F.lit(None).cast("string").alias("value"), F.lit(VOTE_UNIT).cast("long").alias("vote"), F.struct(*[pad.alias(f"o{i}") for i in range(width)]).alias("order")))
    long = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.inline(F.array_compact(F.array(*entries))))
    votes = long.groupBy("__key", "field", "norm").agg(F.sum("vote").alias("votes"), F.max(F.struct("order", "value")).alias("top"))
    strength = F.struct("votes", "top.order", "norm")
    winners = votes.groupBy("__key").agg(
        F.sum(F.when(F.col("field") == "", F.col("votes"))).alias("__rows"),
        *[F.max_by(F.when(F.col("field") == f.name, F.col("top.value")), F.when(F.col("field") == f.name, strength)).alias(f"__{i}") for i, f in enumerate(fields)],
    )
    picked = []
    for i, f in enumerate(fields):
        c = F.col(f"__{i}").cast(f.type)
        picked.append((c if f.default is None else F.coalesce(c, F.lit(f.default).cast(f.type))).alias(f.name))
    rows = (F.col("__rows") / VOTE_UNIT).cast("long")
    return winners.where(rows >= min_rows).select(F.col("__key").alias(key), rows.alias("n_rows"), *picked)
