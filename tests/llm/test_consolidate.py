import pytest
from pyspark.sql import functions as F

from siftmill.llm.consolidate import Field, consolidate, decayed
from siftmill.llm.queries import digest, instant

C = F.col


def test_votes_and_orders(spark):
    rows = [("k", 1, "A", 1.0), ("k", 2, "a ", 1.0), ("k", 3, "B", 1.5), ("k", 4, None, 9.0), ("j", 5, "z", 1.0), (None, 6, "A", 1.0), (None, 7, "A", 1.0)]
    df = spark.createDataFrame(rows, "key string, id long, v string, w double")
    fields = [Field("v", C("v"), [-C("id")], F.lower(F.trim("v")), C("w")), Field("keeper", C("id"), [C("id")], type="long"), Field("none", C("id"), [C("id")], where=F.lit(False), type="long", default=0)]
    out = {r["key"]: r for r in consolidate(df, "key", fields).collect()}
    assert set(out) == {"k"}
    assert (out["k"]["v"], out["k"]["keeper"], out["k"]["none"], out["k"]["n_rows"]) == ("A", 4, 0, 4)
    assert consolidate(df, "key", fields, min_rows=1).count() == 2
    assert consolidate(df.limit(0), "key", fields).count() == 0


def test_ties_and_repeated_rows(spark):
    df = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "b"), ("m", "a"), ("m", "b")], "key string, v string").selectExpr("*", "1 as field", "2 as norm", "3 as votes")
    out = {r["key"]: r["v"] for r in consolidate(df, "key", [Field("v", C("v"), [F.lit(0)])]).collect()}
    assert out == {"k": "b", "m": "b"}  # more votes; then the greatest value


def test_decay(spark):
    df = spark.createDataFrame([("2026-01-01",), ("2025-01-01",), (None,), ("2027-01-01",)], "d string")
    now = F.lit("2026-01-01").cast("timestamp")
    got = [round(r[0], 6) for r in df.select(decayed(F.lit(2.0), C("d").cast("timestamp"), now, 365.0)).collect()]
    assert got == [2.0, 1.0, round(2 * 0.5**10, 6), 2.0]


@pytest.mark.parametrize("text,want", [(" SHA256:" + "AB" * 32 + " ", "ab" * 32), ("0" * 64, None), ("n/a", None), (None, None), ("a" * 63, None)])
def test_digest(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(digest(C("s"))).first()[0] == want


def test_instants(spark):
    rows = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "2024-01-02T03:04:05.5+02:00", "2024-13-45T00:00:00Z", "n/a", "", None, "0000-00-00T00:00:00Z"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [r[0] for r in df.select(F.unix_millis(instant(C("s")))).collect()]
    assert got == [1704164645000, 1704164645000, 1704157445500, None, None, None, None, None]
