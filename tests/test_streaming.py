import random

from pyspark.sql import functions as F

from siftmill.streaming import batches, guards


def test_breaker_steps():
    s = ("CLOSED", 0, 0.0)
    for i in range(10):
        *s, through = guards.step(*s, float(i), True)
        assert through
    assert s[0] == "OPEN" and s[2] == 69.0
    assert guards.step(*s, 20.0, False) == ("OPEN", 10, 69.0, False)
    assert guards.step(*s, 69.0, False) == ("CLOSED", 0, 0.0, True)
    assert guards.step(*s, 70.0, True) == ("OPEN", 11, 130.0, True)


def test_breaker_on_a_stream(spark, tmp_path):
    rows = [(i, "a" if i % 2 else "b", 1_700_000_000 + i, i % 2 == 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string, s long, bad boolean").withColumn("at", F.timestamp_seconds("s"))
    for i in range(3):
        df.where((F.col("id") >= 20 * i) & (F.col("id") < 20 * i + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = batches.stream_table(spark, str(tmp_path / "in"), 1)
    states = batches.last_states(guards.breaker(stream, "k", "at", "id", "bad"))
    last = {r["key"]: r["m"] for r in states.groupBy("key").agg(F.max(F.struct("batch", "calls", "turned_away", "opened", "state")).alias("m")).collect()}
    assert (last["b"]["calls"], last["b"]["turned_away"], last["b"]["state"]) == (30, 0, "CLOSED")
    assert (last["a"]["calls"], last["a"]["turned_away"], last["a"]["opened"], last["a"]["state"]) == (30, 20, 1, "OPEN")


def test_sliding_counts(spark):
    df = spark.createDataFrame([("a", 0), ("a", 30), ("a", 60), ("a", 61), ("b", 61)], "k string, s long").withColumn("at", F.timestamp_seconds("s"))
    assert [r["in_window"] for r in guards.sliding_counts(df, "k", "at").orderBy("k", "s").collect()] == [1, 2, 3, 3, 1]


def test_sliding_counts_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aaab"), rnd.randrange(1500), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, s long, id long").withColumn("at", F.timestamp_seconds("s"))
    want = {i: sum(k == x and s - 60 <= t <= s for x, t, _ in rows) for k, s, i in rows}
    for stretch in (60, 77, 600):
        got = guards.sliding_counts(df, "k", "at", 60, stretch)
        assert got.columns == [*df.columns, "in_window"] and {r["id"]: r["in_window"] for r in got.collect()} == want


def test_named_streams_go_on(spark, tmp_path):
    place = str(tmp_path / "in")
    count = lambda: batches.stream_table(spark, place).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.createDataFrame([("a",), ("b",)], "k string").coalesce(1).write.mode("append").parquet(place)
    batches.clear(spark, "counts")
    assert {(r["k"], r["n"]) for r in batches.last_states(count(), "counts").collect()} == {("a", 1), ("b", 1)}
    assert batches.last_states(count(), "counts").count() == 2  # nothing new
    spark.createDataFrame([("a",)], "k string").coalesce(1).write.mode("append").parquet(place)
    assert sorted((r["batch"], r["k"], r["n"]) for r in batches.last_states(count(), "counts").collect()) == [(0, "a", 1), (0, "b", 1), (1, "a", 2)]
    batches.clear(spark, "counts")
