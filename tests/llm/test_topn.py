import random

import pytest

from siftmill.llm import topn as T
from siftmill.llm.topn import latest, top_n

SCHEMA = "g string, s double, a long, b long"


def brute(rows, n):
    groups = {}
    for r in rows:
        if r[1] is not None and r[1] == r[1]:
            groups.setdefault(r[0], []).append(r)
    low = lambda x: (x is not None, x if x is not None else 0)
    return sorted((g, i + 1, r[1], r[2], r[3]) if g is not None else ("", i + 1, r[1], r[2], r[3]) for g, rs in groups.items() for i, r in enumerate(sorted(rs, key=lambda r: (-r[1], low(r[2]), low(r[3])))[:n]))


def got(df):
    return sorted((r["g"] or "", r["rank"], r["s"], r["a"], r["b"]) for r in df.collect())


def key(rows):
    return [tuple(-1 if x is None else x for x in r) for r in rows]


@pytest.mark.parametrize("bound", [50_000, 0])
def test_against_brute_force(spark, bound):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 5 + [None, "x", "y"] + [f"t{i}" for i in range(40)]), rnd.choice([None, float("nan"), 1.0, 2.0, 2.0, 3.5, rnd.random() * 100]), rnd.randrange(6), i) for i in range(1500)]
    rows += rows[:50]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(key(got(top_n(df, "g", "s", ["a", "b"], 5, broadcast_groups=bound)))) == sorted(key(brute(rows, 5)))


@pytest.mark.parametrize("bound,after_ranking", [(50_000, False), (3, True)])
def test_full_groups_are_always_removed(spark, monkeypatch, bound, after_ranking):
    plans, keep = [], T.stored
    monkeypatch.setattr(T, "stored", lambda df, name="part", by=None: (plans.append((name, df._jdf.queryExecution().toString())), keep(df, name, by))[1])
    df = spark.createDataFrame([(f"g{i % 40}", float(i), i, 0) for i in range(4000)], SCHEMA)
    assert top_n(df, "g", "s", ["a"], 5, broadcast_groups=bound).count() == 200
    bands = [p for name, p in plans if name == "topn-band"][1:]
    assert bands and all("LeftAnti" in p and "PartitionFilters: [isnotnull(__band" in p for p in bands)
    last = bands[-1][bands[-1].index("== Optimized") : bands[-1].index("== Physical")]
    assert (last.index("LeftAnti") < last.index("row_number")) is after_ranking


def test_bands_do_not_show(spark):
    rows = [("g", float(i % 7), i, 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    results = [key(got(top_n(df, "g", "s", ["a"], 3, band_shares=shares))) for shares in ((), (0.5,), (0.001, 0.01, 0.1, 0.5))]
    assert results[0] == results[1] == results[2] == [("g", 1, 6.0, 6, 0), ("g", 2, 6.0, 13, 0), ("g", 3, 6.0, 20, 0)]


def test_empty_and_clashing_columns(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "s", ["a"], 5).count() == 0
    df = spark.createDataFrame([("g", 1.0, 1, 9)], "g string, s double, a long, rank long").withColumnRenamed("a", "__have_not")
    out = top_n(df, "g", "s", ["__have_not"], 5)
    assert out.columns == ["g", "s", "__have_not", "rank"] and out.first()["rank"] == 1
    with pytest.raises(ValueError):
        top_n(df, "g", "s", [], 0)


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, None, 3), (None, 1, 4), (2, None, 5)], "k long, t long, id long")
    assert sorted((r["k"] or 0, r["id"]) for r in latest(df, ["k"], ["t", "id"], ["id"]).collect()) == [(0, 4), (1, 2), (2, 5)]
