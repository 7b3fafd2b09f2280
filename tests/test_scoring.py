import pytest
from helpers import AS_OF, classes, digest, files

from siftmill.operators.scoring import domain_distribution, score_files


def score(spark, classified=(), **row):
    rows = [row] + [{"sha256": row["sha256"]} for _ in range(row.pop("copies", 1) - 1)]
    return next(r for r in score_files(files(spark, *rows), classes(spark, *[(1, *c) for c in classified]), AS_OF).collect() if r["file_id"] == 1)


def test_quality(spark):
    empty = score(spark, size_bytes=0)
    assert 0 <= empty["quality"] <= 30
    rich = score(spark, [("PROG", "python", 85.0), ("PROG", "testing", 70.0)], size_bytes=50_000, content_sample="# Title\n\n- item\n\n```\ndef x\n```\n\n" * 10, sha256=digest("a"), mime_type="text/plain")
    assert rich["quality"] >= 40 and rich["classification_count"] == 2 and rich["primary_domain"] == "PROG"


def test_staleness(spark):
    assert score(spark)["staleness"] <= 10
    assert score(spark, modified_at="2020-01-01T00:00:00Z", accessed_at="2020-01-01T00:00:00Z")["staleness"] >= 75
    assert score(spark, modified_at="2020-01-01T00:00:00Z")["staleness"] == 54.0


def test_uniqueness(spark):
    assert score(spark, sha256=digest("a"))["uniqueness"] == 100
    assert score(spark, sha256=digest("a"), copies=2)["uniqueness"] == 50
    assert score(spark, sha256=digest("a"), copies=10)["uniqueness"] <= 15


@pytest.mark.parametrize("text,low,high", [("SSN: 123-45-6789", 80, 100), ("api_key=" + "secret_" + "a1B2" * 6, 70, 100), ("Cooking pasta takes ten minutes.", 0, 30), (None, 0, 0)])
def test_sensitivity(spark, text, low, high):
    assert low <= score(spark, content_sample=text)["sensitivity"] <= high


def test_sensitivity_by_name_and_domain(spark):
    assert score(spark, filename="passwords.txt")["sensitivity"] == 85 and score(spark, filename="x.pem")["sensitivity"] == 90
    assert score(spark, [("MED", "x", 1.0), ("FIN", "y", 1.0)])["sensitivity"] == 37.5


def test_risk(spark):
    assert score(spark, filename="run.exe", parent_dir=r"C:\Users\x\AppData\Local\Temp")["risk"] >= 50
    assert score(spark, filename="salaries.xlsx", path=r"\\server\public\salaries.xlsx", content_sample="SSN: 123-45-6789")["risk"] >= 50
    assert score(spark)["risk"] == 0
    assert score(spark, [("CYBER", "malware", 85.0)])["risk"] == 50


def test_all_scores_in_range_and_nulls(spark):
    none = {c: None for c in ("path", "size_bytes", "created_at", "modified_at", "accessed_at", "sha256", "content_sample", "mime_type", "parent_dir", "depth", "is_binary")}
    rows = score_files(files(spark, none | {"filename": "x"}, {}), classes(spark), AS_OF).collect()
    assert len(rows) == 2
    for r in rows:
        assert all(0 <= r[c] <= 100 for c in ("quality", "importance", "sensitivity", "staleness", "uniqueness", "risk", "overall"))
    assert score_files(files(spark, {}).limit(0), classes(spark), AS_OF).count() == 0


def test_distribution(spark):
    got = {(r["file_id"], r["domain"]): r["score"] for r in domain_distribution(classes(spark, (1, "A", "x", 0.1), (1, "A", "y", 0.2), (1, "B", "x", 3.0))).collect()}
    assert got == {(1, "A"): 0.3, (1, "B"): 3.0}
