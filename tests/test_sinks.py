from siftmill.sources import sinks
from siftmill.sources.sinks import chunks, enough_room, storage_summary, write_json


def test_sinks(spark, tmp_path):
    df = spark.range(1234)
    rows = chunks(df, "id", 500).collect()
    sizes = {}
    for r in rows:
        sizes[r["chunk"]] = sizes.get(r["chunk"], 0) + 1
    assert len(rows) == 1234 and max(sizes.values()) <= 500
    write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1234
    got = storage_summary(spark, [str(tmp_path), str(tmp_path / "missing")]).collect()
    assert len(got) == 1 and got[0]["status"] in ("critical", "warning", "available") and got[0]["total_bytes"] >= got[0]["free_bytes"]
    assert enough_room(str(tmp_path), 0.0) and not enough_room(str(tmp_path), 1e12)


def test_audit(spark, tmp_path):
    for i in range(2):
        sinks.audit(spark, str(tmp_path / "log"), "export", rows=i)
    assert sorted((r["action"], r["rows"]) for r in spark.read.json(str(tmp_path / "log")).collect()) == [("export", 0), ("export", 1)]
