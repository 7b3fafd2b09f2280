import random
import time
from itertools import product

import numpy as np
import pytest

from siftmill.llm import mixing as M


def test_knapsack_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        lengths = rnd.sample(range(1, 30), 4)
        counts = [rnd.randrange(4) for _ in lengths]
        budget = rnd.randrange(80)
        best = max(s for s in (sum(n * w for n, w in zip(take, lengths)) for take in product(*(range(c + 1) for c in counts))) if s <= budget)
        taken = M.knapsack(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert sum(t * w for t, w in zip(taken, lengths)) == best


def test_fit_reaches_the_budget():
    rnd = np.random.default_rng(1)
    lengths = np.unique(rnd.integers(5, 3000, 500))
    counts = rnd.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.0, 0.1, 0.5, 0.99, 1.0):
        take = M.fit(lengths, counts, int(total * share))
        assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == int(total * share)


def test_fit_against_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(rnd.sample(range(1, 60), 4)))
        counts = np.array([rnd.randrange(5) for _ in lengths])
        budget = rnd.randrange(1, 200)
        best = max(s for s in (sum(n * w for n, w in zip(take, lengths)) for take in product(*(range(c + 1) for c in counts))) if s <= budget)
        take = M.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == best


def test_nearest_fit():
    rnd = random.Random(5)
    for _ in range(60):
        lengths = np.array(sorted(rnd.sample(range(1, 60), 4)))
        counts = np.array([rnd.randrange(5) for _ in lengths])
        budget = rnd.randrange(0, 200)
        best = min((abs(s - budget), s) for s in {sum(n * w for n, w in zip(take, lengths)) for take in product(*(range(c + 1) for c in counts))})
        take = M.nearest_fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs(int((take * lengths).sum()) - budget) == best[0]


@pytest.mark.parametrize("budget,best", [(200_000, 145_000), (100_000, 75_000), (5_000, 5_000), (69_999, 5_000), (140_100, 140_100)])
def test_long_and_short_documents(budget, best):
    lengths, counts = np.array([100, 70_000]), np.array([50, 10])
    assert int((M.fit(lengths, counts, budget) * lengths).sum()) == best


def test_many_lengths_and_large_budgets():
    rnd = np.random.default_rng(3)
    lengths = np.unique(np.concatenate([rnd.integers(1, 3_000, 3_000), rnd.integers(60_000, 40_000_000, 20_000)]))
    counts = rnd.integers(1, 4, len(lengths))
    total = int((lengths * counts).sum())
    began = time.perf_counter()
    for share in (0.3, 0.77):
        take = M.fit(lengths, counts, int(total * share))
        assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == int(total * share)
    long = np.unique(rnd.integers(3_000_000, 40_000_000, 300))
    take = M.fit(long, np.ones(len(long), np.int64), 100_000_000)
    assert 99_900_000 <= int((take * long).sum()) <= 100_000_000
    assert time.perf_counter() - began < 60


def test_budgets_keep_proportions_and_caps():
    plan = M.budgets([("a", 0.5, 1, 1000), ("b", 0.3, 1, 1000), ("c", 0.2, 3, 10), ("d", 0.0, 1, 50), ("e", 0.1, 1, 0)], 800)
    got = {b.source: b.tokens for b in plan}
    assert sum(got.values()) == 800 and got["c"] == 30 and got["d"] == got["e"] == 0
    assert abs(got["a"] / got["b"] - 5 / 3) < 0.01
    assert M.common_total([("a", 0.5, 1, 100), ("b", 0.5, 1, 1000)], 1.0) == 200
    assert M.common_total([], 0.75) == 0


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "RANKED", 20)
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None, "unlisted"]), rnd.choice([None, 0, 7, 7, 7, rnd.randrange(1, 400), 900])) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").selectExpr("*", "1 as copies", "2 as u", "3 as bucket")
    weights = spark.createDataFrame([("a", 0.4, 2), ("b", 0.4, 3), ("c", 0.2, 1), ("z", 0.1, 5)], "source string, target_weight double, max_repeats int")
    mixed, report = M.mix(sized, weights, total=150_000, seed=3)
    rows_, shares = mixed.collect(), {r["source"]: r for r in report.collect()}
    size = {r[0]: (r[1], r[2]) for r in rows}
    assert len({r["doc_id"] for r in rows_}) == len(rows_)
    assert all(size[r["doc_id"]] == (r["source"], r["n_tokens"]) for r in rows_)
    caps = {"a": 2, "b": 3, "c": 1}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in rows_)
    for s, r in shares.items():
        assert r["actual_tokens"] == sum(x["n_tokens"] * x["copies"] for x in rows_ if x["source"] == s)
        assert 0 <= r["budget_tokens"] - r["actual_tokens"] <= (0 if s != "z" else 0)
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    again = M.mix(sized.repartition(7), weights, total=150_000, seed=3)[0]
    assert sorted(again.collect()) == sorted(rows_)
    assert sorted(M.mix(sized, weights, total=150_000, seed=4)[0].collect()) != sorted(rows_)


def test_empty_and_doubled(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    weights = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 1), ("b", None, None)], "source string, target_weight double, max_repeats int")
    mixed, report = M.mix(sized, weights)
    assert mixed.count() == 0 and {r["source"] for r in report.collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        M.mix(sized, weights.union(weights))


@pytest.mark.parametrize("short", [0, 20])
def test_long_documents_fill_the_rest(spark, monkeypatch, short):
    monkeypatch.setattr(M, "RANKED", 7)
    rnd = random.Random(short)
    rows = [(i, "a", 600 + rnd.randrange(400)) for i in range(40)] + [(100 + i, "a", rnd.randrange(1, 30)) for i in range(short)] + [(200, "a", 9_000)]
    sized, total = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), sum(r[2] for r in rows)
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    for seed in range(3):
        mixed, report = M.mix(sized, weights, total=total // 2, seed=seed, nearest=False)
        used, size = {r["doc_id"] for r in mixed.collect()}, {i: n for i, _, n in rows}
        left = total // 2 - sum(size[i] for i in used)
        assert left == total // 2 - report.collect()[0]["actual_tokens"]
        # nothing that was left out fits any more
        assert 0 <= left < 1_000 and all(size[i] > left for i in size if i not in used)


def test_default_size_keeps_every_share(spark):
    rows = [(i, "a", 1) for i in range(900)] + [(1000 + i, "b", 1) for i in range(10)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    weights = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 1), ("c", 0.5, 1)], "source string, target_weight double, max_repeats int")
    report = {r["source"]: (r["actual_tokens"], r["actual_share"], r["reachable_share"], r["deviation"]) for r in M.mix(sized, weights)[1].collect()}
    assert report == {"a": (40, 0.8, 0.8, 0.0), "b": (10, 0.2, 0.2, 0.0), "c": (0, 0.0, 0.0, 0.0)}


def test_long_and_short_documents_keep_their_parts():
    """Each length has one document: a tenth of the tokens is about a tenth of the documents, not the longest of them."""
    lengths = np.arange(100, 1100)
    counts, total = np.ones(1000, np.int64), int(lengths.sum())
    for share in (0.02, 0.1, 0.5, 0.9):
        take = M.fit(lengths, counts, int(total * share))
        assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == int(total * share)
        assert abs(int(take.sum()) - 1000 * share) <= 0.15 * 1000 * share
        short = int((take * lengths)[:500].sum()) / int((take * lengths).sum())
        assert abs(short - int(lengths[:500].sum()) / total) < 0.1
