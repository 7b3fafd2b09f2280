"""A rate over a sliding window, and a circuit breaker as a keyed state machine on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAILURES, OPEN_SECONDS = 10, 60.0


def sliding_counts(events: DataFrame, key: str, at: str, seconds: int = 60, stretch: int = 600) -> DataFrame:
    """Each event with the number of events of its key in the ``seconds`` up to it, itself included.

    Time is cut into stretches of ``stretch`` seconds (at least ``seconds``); the end of each is given to the next one too, so
    a key with a third of all events is as many groups as it has stretches. Events without a time count among themselves.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    length = max(stretch, seconds) * 1_000_000
    own = F.floor(micros / length)
    late = own * length + length - micros <= seconds * 1_000_000
    places = F.array_compact(F.array(F.struct(own.alias("part"), F.lit(True).alias("own")), F.when(late, F.struct((own + 1).alias("part"), F.lit(False).alias("own")))))
    spread = events.withColumn("__at", micros).withColumn("__p", F.explode(places))
    span = Window.partitionBy(key, "__p.part").orderBy("__at").rangeBetween(-seconds * 1_000_000, 0)
    return spread.withColumn("in_window", F.count(F.lit(1)).over(span)).where("__p.own").drop("__at", "__p")


def step(state: str, failures: int, open_until: float, at: float, failed: bool) -> tuple[str, int, float, bool]:
    """The breaker after one call: (state, failures, open_until, let through). Open calls are turned away and change nothing."""
    if state == "OPEN":
        if at < open_until:
            return state, failures, open_until, False
        state = "HALF_OPEN"
    if not failed:
        return "CLOSED", 0, 0.0, True
    failures += 1
    if state == "HALF_OPEN" or failures >= FAILURES:
        return "OPEN", failures, at + OPEN_SECONDS, True
    return state, failures, open_until, True


def breaker(events: DataFrame, key: str, at: str, id: str, failed: str) -> DataFrame:
    """(key, calls, turned_away, opened, state) after each micro-batch of a stream of calls; the state of a key is four values.

    Events of a batch are taken in the order of their time.
    """
    kind = dict(events.dtypes)[key]

    def run(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, failures, until, calls, away, opened = held.get if held.exists else ("CLOSED", 0, 0.0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        for t, bad in zip(rows["at"], rows["failed"]):
            before = state
            state, failures, until, through = step(state, failures, until, t, bool(bad))
            calls, away, opened = calls + 1, away + (not through), opened + (state == "OPEN" and before != "OPEN")
        held.update((state, failures, until, calls, away, opened))
        yield pd.DataFrame({"key": [name[0]], "calls": [calls], "turned_away": [away], "opened": [opened], "state": [state]})

    source = events.select(F.col(key).alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"), F.col(id).alias("id"), F.expr(failed).alias("failed"))
    schema = "state string, failures int, until double, calls long, away long, opened long"
    return source.groupBy("key").applyInPandasWithState(run, f"key {kind}, calls long, turned_away long, opened long, state string", schema, "update", GroupStateTimeout.NoTimeout)
