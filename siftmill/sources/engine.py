"""Asking an outside engine about rows: answers are kept for a while, calls are limited, repeated and, after failures, withheld."""

from __future__ import annotations

import json
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.guards import step

#: Seconds that an answer is kept, and how many are; calls that may be made in so many seconds; how often a call is made.
KEPT_SECONDS, KEPT_ANSWERS = 300.0, 10_000
CALLS, CALLS_SECONDS = 500, 60.0
ATTEMPTS = 3

Call = Callable[[str, dict], dict]


class Withheld(Exception):
    """The breaker is open: the engine isn't called."""


class EngineClient:
    """Calls ``call(kind, question)`` behind a store of answers, a limit for a sliding window, a circuit breaker and repetition.

    Waits between attempts shrink by half each time. One client serves one Python worker.
    """

    def __init__(self, call: Call, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.call, self.clock, self.sleep = call, clock, sleep
        self.answers: OrderedDict[tuple[str, str], tuple[float, dict]] = OrderedDict()
        self.made: deque[float] = deque()
        self.state: tuple[str, int, float] = ("CLOSED", 0, 0.0)
        self.seconds: deque[float] = deque(maxlen=1000)

    def ask(self, kind: str, question: dict) -> dict:
        key = kind, json.dumps(question, sort_keys=True)
        held = self.answers.get(key)
        if held is not None and self.clock() - held[0] < KEPT_SECONDS:
            self.answers.move_to_end(key)
            return held[1]
        for attempt in range(ATTEMPTS):
            try:
                answer = self._once(kind, question)
                break
            except Withheld:
                raise
            except Exception:
                if attempt + 1 == ATTEMPTS:
                    raise
                self.sleep(0.5**attempt)
        self.answers[key] = self.clock(), answer
        while len(self.answers) > KEPT_ANSWERS:
            self.answers.popitem(last=False)
        return answer

    def _once(self, kind: str, question: dict) -> dict:
        now = self.clock()
        if self.state[0] == "OPEN" and now < self.state[2]:
            raise Withheld(kind)
        while self.made and now - self.made[0] >= CALLS_SECONDS:
            self.made.popleft()
        if len(self.made) >= CALLS:
            self.sleep(CALLS_SECONDS - (now - self.made[0]))
            now = self.clock()
            self.made.popleft()
        self.made.append(now)
        try:
            answer = self.call(kind, question)
        except Exception:
            *self.state, _ = step(*self.state, self.clock(), True)
            self.state = tuple(self.state)
            raise
        self.seconds.append(self.clock() - now)
        self.state = tuple(step(*self.state, self.clock(), False)[:3])
        return answer

    def latency(self, share: float) -> float | None:
        """The latency that ``share`` of the last thousand calls kept below."""
        known = sorted(self.seconds)
        return known[min(len(known) - 1, int(share * len(known)))] if known else None


def asked(rows: DataFrame, id: str, question: str, kind: str, connect: Callable[[], Call]) -> DataFrame:
    """(id, answer, error): the answers, as JSON, to the questions of all rows. ``connect`` makes the call in a worker.

    A question that stays without an answer keeps its row with the kind of error; null questions have neither. Every worker
    limits itself, so the limit for all is that of one times the number of workers.
    """
    kind_of = dict(rows.dtypes)[id]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = EngineClient(connect())
        for batch in batches:
            answers, errors = [], []
            for text in batch.column(1).to_pylist():
                answer = error = None
                if text is not None:
                    try:
                        answer = json.dumps(client.ask(kind, {"text": text}), sort_keys=True)
                    except Exception as e:
                        error = type(e).__name__
                answers.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["id", "answer", "error"])

    return rows.select(F.col(id).alias("id"), F.col(question).alias("q")).mapInArrow(run, f"id {kind_of}, answer string, error string").withColumnRenamed("id", id)
