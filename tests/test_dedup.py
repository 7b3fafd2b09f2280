import random

from helpers import classes, digest, files
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import dedup as D


def one(df):
    return {r["cluster"]: r for r in df.collect()}


def test_exact(spark):
    df = files(spark, {"sha256": digest("a")}, {"sha256": " SHA256:" + digest("A")}, {"sha256": digest("d")}, {"sha256": None}, {"sha256": None})
    got = one(D.clusters(D.exact_keys(df)))
    assert list(got) == [digest("a")] and got[digest("a")]["file_count"] == 2 and got[digest("a")]["wasted_bytes"] == 1024
    rows = D.members(D.exact_keys(df), D.clusters(D.exact_keys(df))).collect()
    assert sorted((r["file_id"], r["is_keeper"]) for r in rows) == [(1, True), (2, False)]


def test_strategies(spark):
    rows = [
        {"modified_at": "2025-01-01T00:00:00Z", "size_bytes": 5, "depth": 2, "accessed_at": None},
        {"modified_at": "2026-02-27T00:00:00Z", "size_bytes": 9, "depth": 4, "accessed_at": "2026-01-01T00:00:00Z"},
        {"modified_at": None, "size_bytes": 9, "depth": 1, "accessed_at": "2026-01-02T00:00:00Z", "parent_dir": r"O:\Fin"},
    ]
    df = files(spark, *[r | {"sha256": digest("a")} for r in rows])
    scores = spark.createDataFrame([(1, 70.0, "FIN"), (3, 60.0, "FIN")], "id long, quality double, primary_domain string")
    keyed = D.exact_keys(df.join(scores, "id", "left"))
    keeper = lambda s: D.clusters(keyed, s).first()["keeper_id"]
    assert [keeper(s) for s in D.STRATEGIES] == [2, 2, 3, 3, 1, 3]
    plain = D.exact_keys(df.withColumn("quality", F.lit(None).cast("double")).withColumn("primary_domain", F.lit(None).cast("string")))
    assert D.clusters(plain, "keep_highest_quality").first()["keeper_id"] == 2  # no score at all: the newest


def test_near(spark):
    df = files(spark, {"content_sample": "Hello, World!", "sha256": digest("a")}, {"content_sample": "hello world", "sha256": digest("b")}, {"content_sample": "other", "sha256": digest("c")}, {"content_sample": "other!", "sha256": digest("c")}, {"content_sample": "hello world", "is_binary": 1, "sha256": digest("d")})
    got = list(one(D.clusters(D.near_keys(df), differing=True)).values())
    assert len(got) == 1 and got[0]["file_count"] == 2


def test_overlap_links_against_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"{a}{b}c" for a in "abcdefgh" for b in "mnopqrst"]
    texts = []
    for _ in range(40):
        base = rnd.sample(vocabulary, rnd.randrange(5, 25))
        texts += [" ".join(base), " ".join(base[: max(3, len(base) - rnd.randrange(4))]), " ".join(rnd.sample(base, len(base)))]
    df = spark.createDataFrame([(i, rnd.choice("xy"), t) for i, t in enumerate(texts)], "id long, block string, t string").withColumn("k", T.keyword_set(F.col("t")))
    member, links = D.overlap_links(df, "block", "id", "k", 0.8)
    rows = {r["id"]: (r["block"], frozenset(r["k"])) for r in df.collect()}
    of = {r["id"]: r["class_id"] for r in member.collect()}
    assert all(of[i] == min(j for j in rows if rows[j] == rows[i]) for i in rows)
    reps = sorted(set(of.values()))
    want = {(a, b) for a in reps for b in reps if a < b and rows[a][0] == rows[b][0] and len(rows[a][1] & rows[b][1]) >= 0.8 * len(rows[a][1] | rows[b][1])}
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} == want and len(want) > 5


def test_first_stars_against_one_by_one(spark):
    rnd = random.Random(5)
    edges = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(90)} | {(i, i + 1) for i in range(100, 140)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            want[n] = n
            for m in near[n]:
                if m > n:
                    want.setdefault(m, n)
    got = {r["node"]: r["seed"] for r in D.first_stars(spark.createDataFrame(sorted(edges), "a long, b long"), "a", "b").collect()}
    assert got == want
    assert D.first_stars(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_all_kinds_are_disjoint(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = files(spark, {"sha256": digest("a"), "content_sample": text}, {"sha256": digest("a"), "content_sample": text}, {"sha256": digest("b"), "content_sample": text + " lambda"}, {"sha256": digest("c"), "content_sample": text + " LAMBDA!"}, {"sha256": digest("d"), "content_sample": text + " mu nu"}, {"sha256": digest("e"), "content_sample": text + " mu"})
    df = df.withColumn("quality", F.lit(None).cast("double")).withColumn("primary_domain", F.lit(None).cast("string"))
    got = D.all_duplicates(df, classes(spark, *[(i, "P", "t", 1.0) for i in range(1, 7)]), "keep_newest").collect()
    assert sorted((r["kind"], r["file_count"], r["keeper_id"]) for r in got) == [("exact", 2, 1), ("near", 2, 3), ("semantic", 2, 5)]


def test_long_chains_are_decided(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(700)], "a long, b long")
    got = {r["node"]: r["seed"] for r in D.first_stars(links, "a", "b", rounds=2).collect()}
    assert got == {i: i - i % 2 for i in range(701)}


def test_blocks_are_decided_alike(spark):
    """Blocks in tasks of their own, large blocks in rounds and all in rounds give the same; a chain of ten thousand links ends."""
    rnd = random.Random(9)
    rows = [(f"b{k}", k * 1000 + a, k * 1000 + b) for k in range(6) for a in range(30) for b in range(a + 1, 30) if rnd.random() < 0.12]
    links = spark.createDataFrame(rows, "block string, a long, b long")
    want = {(r["node"], r["seed"]) for r in D.first_stars(links, "a", "b").collect()}
    for at_once in (10**6, sum(r[0] == "b1" for r in rows) - 1, 0):
        assert {(r["node"], r["seed"]) for r in D.first_stars_by_block(links, "block", "a", "b", at_once).collect()} == want
    chain = spark.createDataFrame([("x", i, i + 1) for i in range(10_000)], "block string, a long, b long")
    got = {r["node"]: r["seed"] for r in D.first_stars_by_block(chain, "block", "a", "b").collect()}
    assert got == {i: i - i % 2 for i in range(10_001)}


def test_members_of_all_duplicates(spark):
    same, near = "Some text of a file.", "some TEXT of a file"
    df = files(spark, {"content_sample": same, "sha256": digest("a")}, {"content_sample": same, "sha256": digest("a")}, {"content_sample": near, "sha256": digest("b")}, {"content_sample": near + "!", "sha256": digest("c")}, {"content_sample": None, "sha256": None})
    found, inside = D.keyed_duplicates(df, classes(spark), "keep_newest")
    assert sorted((r["kind"], r["file_count"]) for r in found.collect()) == [("exact", 2), ("near", 2)]
    assert sorted((r["kind"], r["file_id"], r["is_keeper"]) for r in inside.collect()) == [("exact", 1, True), ("exact", 2, False), ("near", 3, True), ("near", 4, False)]
