import pytest

from siftmill.sources import engine as E


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def client(call):
    clock = Clock()
    return E.EngineClient(call, clock, clock.sleep), clock


def test_answers_are_kept_for_a_while(monkeypatch):
    monkeypatch.setattr(E, "KEPT_ANSWERS", 2)
    calls = []
    c, clock = client(lambda kind, q: calls.append(q) or {"n": len(calls)})
    assert c.ask("a", {"text": "x"}) == c.ask("a", {"text": "x"}) == {"n": 1} and c.ask("b", {"text": "x"}) == {"n": 2}
    clock.now = E.KEPT_SECONDS + 1
    assert c.ask("a", {"text": "x"}) == {"n": 3}
    c.ask("a", {"text": "y"}), c.ask("a", {"text": "z"})
    assert c.ask("a", {"text": "x"}) == {"n": 6} and c.latency(0.95) == 0.0


def test_attempts_and_breaker():
    def fail(kind, q):
        raise OSError

    c, clock = client(fail)
    for _ in range(3):
        with pytest.raises(OSError):
            c.ask("a", {})
    assert clock.slept == [1.0, 0.5] * 3 and c.state[1] == 9
    with pytest.raises(E.Withheld):
        c.ask("a", {})
    assert c.state[0] == "OPEN"
    clock.now += 61
    c.call = lambda kind, q: {"ok": 1}
    assert c.ask("a", {}) == {"ok": 1} and c.state == ("CLOSED", 0, 0.0)


def test_limit(monkeypatch):
    monkeypatch.setattr(E, "CALLS", 3)
    c, clock = client(lambda kind, q: {})
    for i in range(7):
        c.ask("a", {"i": i})
    assert sum(clock.slept) == pytest.approx(2 * E.CALLS_SECONDS)


def test_asked(spark):
    def connect():
        def call(kind, q):
            if q["text"] == "bad":
                raise ValueError
            return {"kind": kind, "n": len(q["text"])}

        return call

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "bad")], "k long, q string").coalesce(1)
    got = {r["k"]: (r["answer"], r["error"]) for r in E.asked(df, "k", "q", "size", connect).collect()}
    assert got == {1: ('{"kind": "size", "n": 3}', None), 2: (None, None), 3: (None, "ValueError")}
