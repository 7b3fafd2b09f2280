import math
import random
import time
from itertools import combinations

import numpy as np
import pytest

from siftmill.llm import neardup as N

WORDS = [f"w{i}" for i in range(400)]


def sets(text, k):
    import re

    w = re.findall("[a-z0-9_]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(rnd, n=60):
    texts = []
    for _ in range(n):
        base = [rnd.choice(WORDS) for _ in range(rnd.randrange(25, 90))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(3)):
            other = list(base)
            for _ in range(rnd.randrange(1, 5)):
                other[rnd.randrange(len(other))] = rnd.choice(WORDS)
            texts.append(" ".join(other))
    return texts


@pytest.mark.parametrize("words,threshold", [(3, 0.6), (5, 0.8)])
def test_against_brute_force(spark, words, threshold):
    rnd = random.Random(words)
    texts = corpus(rnd)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[0].upper() + " !") for i in range(40)]  # a hot group of copies
    df = spark.createDataFrame(rows, "id long, text string")
    members, links = N.near_duplicates(df, "id", "text", threshold, words=words, min_words=20)
    of = {r["id"]: r["class_id"] for r in members.collect()}
    assert len(of) == len(rows) and {of[1000 + i] for i in range(40)} == {0}
    assert sum(v == k for k, v in of.items()) == len({frozenset(sets(t, words)) for _, t in rows})
    found = {(r["class_a"], r["class_b"]): r["similarity"] for r in links.collect()}
    want = {}
    for (i, a), (j, b) in combinations(enumerate(texts), 2):
        x, y = sets(a, words), sets(b, words)
        if x != y and len(x & y) / len(x | y) >= threshold:
            want[i, j] = len(x & y) / len(x | y)
    assert len(want) >= 15 and set(found) == set(want)
    assert all(abs(found[p] - want[p]) < 1e-12 for p in want)


def test_agreement_follows_weighted_similarity():
    rnd = np.random.default_rng(5)
    element = rnd.integers(0, 1 << 48, 300, dtype=np.uint64)
    a, b = rnd.uniform(0.2, 3.0, 300), rnd.uniform(0.2, 3.0, 300)
    b[:150] = a[:150]
    k = 4096
    s = N.dart_signatures(np.repeat([0, 1], 300), np.concatenate([element, element]), np.concatenate([a, b]), 2, k)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5


@pytest.mark.parametrize("weight", [1000.0, 1.0, 0.1, 0.02, 0.005, 1e-5, 1e-7])
def test_light_and_heavy_sets(weight):
    rnd = np.random.default_rng(7)
    k, docs = 200, 40
    began = time.perf_counter()
    agree = []
    for _ in range(docs):
        shared, own = rnd.integers(0, 1 << 48, 10, dtype=np.uint64), rnd.integers(0, 1 << 48, 10, dtype=np.uint64)
        element = np.concatenate([shared, own[:5], shared, own[5:]])
        s = N.dart_signatures(np.repeat([0, 1], 15), element, np.full(30, weight), 2, k)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 0.5) < 4 * (0.25 / (k * docs)) ** 0.5
    assert time.perf_counter() - began < 60
    none = N.dart_signatures(np.repeat([0, 1], 15), element, None, 2, 8_000)
    assert abs((none[0] == none[1]).mean() - 0.5) < 4 * (0.25 / 8_000) ** 0.5


def test_banding():
    assert N.banding(1_000, 0.6) == (100, 4) and N.banding(10_000_000, 0.6) == (100, 4)
    for n in (10**3, 10**8, 10**9, 10**10):
        for threshold in (0.6, 0.8):
            bands, rows = N.banding(n, threshold)
            assert (1 - threshold**rows) ** bands <= N.MISSED and rows == max(4, 4 + round(math.log10(n)) - 7)


def test_an_id_with_two_texts(spark):
    a, b = " ".join(WORDS[:30]), " ".join(WORDS[100:130])
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " end"), (3, b + " end")], "id long, text string")
    links = {(r["class_a"], r["class_b"]) for r in N.near_duplicates(df, "id", "text", 0.8)[1].collect()}
    assert len(links) == 1 and links <= {(1, 2), (1, 3)}
    assert N.near_duplicates(df.repartition(5), "id", "text", 0.8)[1].collect()[0][:2] == next(iter(links))


def test_edge_cases(spark):
    long = " ".join(random.Random(1).choices(WORDS, k=60_000))
    rows = [(1, None), (2, ""), (3, "too short"), (None, "a b c d e f g"), (4, long), (5, long + " end"), (6, "x y z u v w"), (6, "x y z u v w")]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "1 as one", "2 as bands", "3 as class_id")
    members, links = N.near_duplicates(df, "id", "text", 0.8)
    assert sorted(r["id"] for r in members.collect()) == [4, 5, 6]
    assert [(r["class_a"], r["class_b"]) for r in links.collect()] == [(4, 5)]
    members, links = N.near_duplicates(df.limit(0), "id", "text", 0.8)
    assert members.count() == links.count() == 0


def test_joins_instead_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    test_against_brute_force(spark, 3, 0.6)
    test_edge_cases(spark)


def test_links_at_the_threshold(spark):
    rows = []
    for i in range(6_000):  # 15 of 25 words are shared
        both = [f"b{i}_{j}" for j in range(15)]
        rows += [(2 * i, " ".join(both + [f"x{i}_{j}" for j in range(5)])), (2 * i + 1, " ".join(both + [f"y{i}_{j}" for j in range(5)]))]
    links = N.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.6, words=1)[1]
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} == {(2 * i, 2 * i + 1) for i in range(6_000)}
