import random

from helpers import classes, digest, files
from pyspark.sql import functions as F

from siftmill.operators import relations as R
from siftmill.plans.functions import imports


def pairs(df):
    return sorted((r["source_id"], r["target_id"]) for r in df.collect())


def test_duplicates(spark):
    assert pairs(R.duplicates(files(spark, {"sha256": digest("a")}, {"sha256": digest("a")}, {"sha256": digest("b")}, {}))) == [(1, 2)]


def test_versions(spark):
    df = files(spark, {"filename": "report_v1.docx", "modified_at": "2025-01-01"}, {"filename": "report_v2.docx", "modified_at": "2026-01-01"}, {"filename": "Report_V3.docx", "modified_at": None}, {"filename": "report.docx"}, {"filename": "other_v1.txt"}, {"filename": "report_copy.docx"})
    assert pairs(R.versioned(df)) == [(1, 2), (3, 1)]


def test_references(spark):
    df = files(spark, {"filename": "a.txt", "content_sample": "See Contract_Final.pdf for details, and x.pdf"}, {"filename": "contract_final.pdf", "content_sample": "contract_final.pdf"}, {"filename": "contract_final.pdf"}, {"filename": "x.pdf"}, {"filename": "final.pdf"}, {"filename": "Makefile", "content_sample": "run the makefiles: ab.cd.ef"}, {"filename": "b.cd.ef"}, {"filename": "noend."})
    assert pairs(R.references(df)) == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 5), (6, 7)]


def test_references_against_brute_force(spark):
    rnd = random.Random(1)
    stems = ["a", "ab", "abc", "abcd", "data.set", "my file", "x(1)", "..", "repört", "n"]
    rows = []
    for _ in range(60):
        name = rnd.choice(stems) + rnd.choice([".", ".t", ".txt", ".tar.gz", "", "longer"])
        text = "".join(rnd.choice([*stems, ".", "t", "xt", ".txt", " ", "\n", "gz", "longer"]) for _ in range(rnd.randrange(40)))
        rows.append({"filename": name or "q", "content_sample": text or None})
    df = files(spark, *rows)
    want = []
    for i, f in enumerate(rows, 1):
        for j, g in enumerate(rows, 1):
            n = g["filename"].lower()
            if i != j and f["content_sample"] and len(n) >= 5 and n in f["content_sample"].lower() and n != f["filename"].lower():
                want.append((i, j))
    assert pairs(R.references(df)) == sorted(want) and len(want) > 20


def test_dependencies(spark):
    df = files(spark, {"filename": "main.py", "content_sample": "from utils import helper\nimport main\nimport os.path"}, {"filename": "utils.py"}, {"filename": "utils.py", "parent_dir": "elsewhere"}, {"filename": "path.txt"}, {"filename": "main.txt"})
    found = imports(F.col("content_sample"), F.col("extension"))
    assert pairs(R.depends_on(df, found)) == [(1, 2), (1, 4), (1, 5)]


def test_co_classified(spark):
    rows = [(f, d, t, 1.0) for f in (1, 2) for d, t in (("PROG", "python"), ("PROG", "testing"), ("CYBER", "security"))] + [(3, "PROG", "python", 1.0)]
    got = R.co_classified(classes(spark, *rows)).collect()
    assert [(r["source_id"], r["target_id"], r["confidence"]) for r in got] == [(1, 2, 0.45)] and got[0]["topics"] == "CYBER:security, PROG:python, PROG:testing"


def test_supersedes(spark):
    df = files(spark, {"filename": "plan_v1.md", "modified_at": "2024"}, {"filename": "plan_v2.md", "modified_at": "2026"}, {"filename": "plan.md", "modified_at": "2025"}, {"filename": "plan_v3.md", "modified_at": None})
    assert pairs(R.supersedes(df, classes(spark, *[(i, "A", "t", 1.0) for i in (1, 2, 3, 4)]))) == [(2, 1), (2, 3)]


def test_empty(spark):
    none = files(spark, {}).limit(0)
    assert R.all_relations(none, classes(spark), imports(F.col("content_sample"), F.col("extension"))).count() == 0


def test_edges_of_one_file_and_in_degrees(spark):
    df = files(
        spark, {"filename": "alpha.py", "content_sample": "see beta_v1.py and gamma.txt", "sha256": digest("a")}, {"filename": "beta_v1.py", "content_sample": "import alpha\nalpha.py", "sha256": digest("b")}, {"filename": "beta_v2.py", "modified_at": "2026-02-28T00:00:00Z", "sha256": digest("a")},
        {"filename": "gamma.txt", "content_sample": "alpha.py", "sha256": digest("c")}, {"filename": "gamma.txt", "parent_dir": r"O:\other", "sha256": digest("c")},
    )
    found = classes(spark, (1, "PROG", "a", 0.9), (2, "PROG", "a", 0.9), (2, "PROG", "b", 0.9), (3, "PROG", "b", 0.5), (1, "PROG", "b", 0.1), (1, "PROG", "c", 0.1), (2, "PROG", "c", 0.1))
    imports = F.array(F.when(F.col("filename") == "beta_v1.py", "alpha"))
    imports = F.array_compact(imports)
    everything = R.all_relations(df, found, imports)
    for i in range(1, 7):
        want = sorted(map(tuple, everything.where(f"source_id = {i} or target_id = {i}").collect()))
        assert sorted(map(tuple, R.edges_of(df, found, imports, i).collect())) == want and (want or i > 5)
    got = {r["file_id"]: r["references"] for r in R.in_degrees(df, imports).collect()}
    assert got == {1: 3, 2: 1, 4: 1, 5: 1}  # named by two and imported by one
