from helpers import classes, files
from pyspark.sql import functions as F

from siftmill.functions import fixed as X
from siftmill.operators import advice as A
from siftmill.operators import library as L

SCORES = "file_id long, sensitivity_score double, staleness_score double, importance_score double, risk_score double, primary_domain string"


def hits(spark, rows, scores, classified=(), copies=(), spare=()):
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id long")
    df = A.recommended(files(spark, *rows), spark.createDataFrame(scores, SCORES), classes(spark, *classified), ids(copies), ids(spare))
    return df, {c: sorted(r["id"] for r in df.collect() if r["category"] == c) for c in A.SEVERITY}


def test_rules(spark):
    rows = [{}, {}, {}, {"parent_dir": r"C:\Downloads"}, {"parent_dir": r"O:\vault\secure"}, {"filename": "x.gpg"}]
    scores = [(1, 20.0, 90.0, 10.0, 20.0, "PROG"), (2, 20.0, 85.0, 15.0, 80.0, "PROG"), (3, 20.0, 20.0, 80.0, 20.0, "PROG"), (4, 85.0, 60.0, 90.0, 0.0, "PROG"), (5, 85.0, 0.0, 0.0, 0.0, "X"), (6, 90.0, 0.0, 0.0, None, None)]
    df, got = hits(spark, rows, scores, [(1, "CYBER", "malware", 85.0), (2, "CYBER", "x", 10.0)], copies=[3], spare=[2, 3])
    assert got["archive"] == [1, 2] and got["secure"] == [4, 6] and got["encrypt"] == [4, 5] and got["review"] == [2] and got["alert"] == [1]
    assert got["backup"] == [4] and got["delete"] == [2, 3] and got["update"] == [4] and got["organize"] == [4]
    out = A.recommendations(df).orderBy("severity_rank", "category").collect()
    assert [r["severity_rank"] for r in out] == sorted(r["severity_rank"] for r in out) and out[0]["category"] == "alert"
    assert {r["category"]: r["affected"] for r in out}["archive"] == "1,2"
    assert {X.SEVERITIES[r["severity_rank"] - 1] == r["severity"] for r in out} == {True}


def test_shown_ids_are_limited_but_counted(spark):
    df = spark.range(2000).select(F.lit("review").alias("category"), "id", F.lit(2).cast("long").alias("size_bytes"))
    out = A.recommendations(df).first()
    assert out["affected_count"] == 2000 and out["total_bytes"] == 4000 and out["affected"] == ",".join(map(str, range(500)))
    assert A.recommendations(df.limit(0)).count() == 0


def test_proposals(spark):
    data = [{"filename": f"d{i}.csv", "parent_dir": r"O:\data", "size_bytes": 300_000} for i in range(6)]
    code = [{"filename": f"c{i}.py", "parent_dir": r"O:\code", "size_bytes": 20_000} for i in range(3)]
    df = files(spark, *data, *code)
    domains = spark.createDataFrame([(i, "TAX") for i in range(1, 7)], "id long, domain string")
    got = A.domain_proposals(df, domains).collect()
    assert [(r["kind"], r["subject"], r["priority"]) for r in got] == [("DATA_PIPELINE", "TAX", 8 + 20 + 20)]
    text = "import argparse\n# TODO later\ndef main():\n    FastAPI(); sqlite\n" + "".join(f"def function_{i}(): pass\n" for i in range(6))
    sigs = L.signatures(spark.createDataFrame([(i, text) for i in (7, 8, 9)], "file_id long, content string"), "file_id")
    assert [r["subject"] for r in A.partial_projects(df, sigs).collect()] == [r"O:\code"]
    assert [r["subject"] for r in A.orphaned_data(df).collect()] == [r"O:\data"]
    assert A.large_scripts(df, sigs).count() == 3
    repeated = A.repeated_functions(spark.createDataFrame([(i, text) for i in (7, 8, 9)], "id long, content string"))
    assert repeated.count() == 6 and A.shared_library(repeated).first()["priority"] == 40 + 6 * 1.5


def test_incomplete_projects(spark):
    df = files(spark, {"filename": "a.py", "parent_dir": "/p/one"}, {"filename": "b.txt", "parent_dir": "/p/one"}, {"filename": "package.json", "parent_dir": "/p/two"}, {"filename": "page.tsx", "parent_dir": "/p/two/app"}, {"filename": "x.md", "parent_dir": "/p/two"}, {"filename": "a.py", "parent_dir": "/p/alone"})
    got = {r["dir"]: (r["project"], r["found"], r["total"], r["pct"]) for r in A.incomplete_projects(df).collect()}
    assert got == {"/p/one": ("python_package", 1, 3, 33.3), "/p/two": ("nextjs_app", 2, 4, 50.0)}
