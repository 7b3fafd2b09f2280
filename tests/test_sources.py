import json
import os
import sqlite3
import zipfile

import pytest

from siftmill.__main__ import main
from siftmill.operators import history
from siftmill.plans import pipeline
from siftmill.sources import samples
from siftmill.sources.filetree import read_tree, validated_roots
from siftmill.sources.samples import docx_sample, json_depth, json_facts, json_keys, sampled, xlsx_sample


@pytest.fixture
def tree(tmp_path):
    for name, text in {"pkg/__init__.py": "x = 1\n", "pkg/_sub/b.py": "import b\n", "prod.env": "A=1", ".env": "B=2", ".hidden/x.txt": "no", "node_modules/y.js": "no", "empty.txt": "", "deep/a/b/c/d.txt": "deep", "big.log": "z" * 5000, "café.md": "# Títle"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return tmp_path


def found(df, root):
    return sorted(os.path.relpath(r["path"], root) for r in df.collect())


def test_tree(spark, tree):
    everything = [".env", "big.log", "café.md", "deep/a/b/c/d.txt", "pkg/__init__.py", "pkg/_sub/b.py", "prod.env"]
    for tasks in (1, 64):
        assert found(read_tree(spark, [str(tree)], tasks=tasks), tree) == everything
    assert found(read_tree(spark, [str(tree)], include=[".py"]), tree) == ["pkg/__init__.py", "pkg/_sub/b.py"]
    assert "big.log" not in found(read_tree(spark, [str(tree)], max_file_size=1000, exclude=[".md"]), tree)
    assert "deep/a/b/c/d.txt" not in found(read_tree(spark, [str(tree)], max_depth=2), tree)
    assert not [f for f in found(read_tree(spark, [str(tree)], protected=[str(tree / "pkg")]), tree) if f.startswith("pkg")]
    assert found(read_tree(spark, [str(tree / "empty.txt")]), tree) == ["empty.txt"]
    assert read_tree(spark, [str(tree / "missing")]).count() == 0
    row = next(r for r in read_tree(spark, [str(tree)]).collect() if r["filename"] == ".env")
    assert row["extension"] == "" and row["depth"] == len(row["path"].split("/")) and row["size_bytes"] == 3


def test_roots():
    assert validated_roots([r"C:\Data", " c:\\data ", "/x"]) == [r"C:\Data", "/x"]
    for bad in ([], [" "], ["x" * 1025], [f"/{i}" for i in range(33)]):
        with pytest.raises(ValueError):
            validated_roots(bad)


def test_samples(spark, tree):
    with sqlite3.connect(tree / "t.sqlite") as db:
        db.execute("CREATE TABLE one (a int)")
    (tree / "bad.sqlite").write_bytes(b"no database")
    with zipfile.ZipFile(tree / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>there</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tree / "s.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    assert docx_sample(tree / "d.docx") == "Hello there" and xlsx_sample(tree / "s.xlsx") == "name 7"
    rows = {r["filename"]: r for r in sampled(read_tree(spark, [str(tree)])).collect()}
    assert rows["t.sqlite"]["content_sample"] == "Tables: one" and rows["bad.sqlite"]["error"] and rows["bad.sqlite"]["sha256"]
    assert len(rows["big.log"]["content_sample"]) == 2048 and rows["café.md"]["content_sample"] == "# Títle"
    assert rows["__init__.py"]["detected_domain"] == "PROG" and rows["__init__.py"]["mime_type"] == "text/x-python" and len({r["id"] for r in rows.values()}) == len(rows)


def test_json(spark):
    data = {"a": {"b": [{"c": 1}, {"d": 2}]}, "e": {}}
    assert json_keys(data) == ["a", "e", "b", "c", "d"] and json_depth(data) == 4
    df = spark.createDataFrame([(1, json.dumps(data)), (2, "no"), (3, None), (4, "[]")], "id long, t string")
    assert sorted((r["id"], r["keys"], r["depth"]) for r in json_facts(df, "id", "t").collect()) == [(1, ["a", "e", "b", "c", "d"], 4), (4, [], 0)]


def test_history(spark, tmp_path):
    schema = "id long, path string, modified_at string, size_bytes long, scan_id long, first_seen_scan_id long, last_modified_scan_id long"
    known = spark.createDataFrame([(1, "a", "t1", 10, 1, 1, None), (2, "b", "t1", 5, 1, 1, None), (3, "c", None, 5, 1, 1, None)], schema)
    now = spark.createDataFrame([(9, "a", "t2", 99, 2, 2, None), (8, "b", "t1", 5, 2, 2, None), (7, "d", "t2", 1, 2, 2, None), (6, "c", None, 5, 2, 2, None)], schema)
    assert sorted(r["path"] for r in history.changed(now, known).collect()) == ["a", "d"]
    merged = {r["path"]: r for r in history.merged(known, now).collect()}
    assert (merged["a"]["id"], merged["a"]["size_bytes"], merged["a"]["first_seen_scan_id"], merged["a"]["last_modified_scan_id"]) == (1, 99, 1, 2)
    assert merged["b"]["last_modified_scan_id"] is None and merged["d"]["id"] == 7 and len(merged) == 4
    history.append_scan(now, str(tmp_path / "h"), 2)
    with pytest.raises(FileExistsError):
        history.append_scan(now, str(tmp_path / "h"), 2)
    history.append_scan(known, str(tmp_path / "h"), 1)
    assert {(r["scan_id"], r["path"], r["size_bytes"]) for r in history.read_scans(spark, str(tmp_path / "h")).collect()} >= {(1, "a", 10), (2, "a", 99)}


def planted(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "service.py").write_text("import notes\nfrom fastapi import FastAPI\ndef run():\n    raise ValueError('no 12')\nKEY_NAME = 'x'\n")
    (src / "records.json").write_text('{"a": 1}')
    (src / "notes.md").write_text("# Notes\nTODO see records.json\n")
    for n in "ab":
        (src / f"duplicate-{n}.txt").write_text("the same line\n" * 60)
    return src


EVERYWHERE = {"files", "recommendations"}
INTELLIGENT = EVERYWHERE | {"classifications", "scores", "domain_stats", "functions", "library", "errors", "proposals", "summaries", "suggestions"}
TABLES = {
    "INTELLIGENCE": INTELLIGENT | {"clusters", "cluster_members", "relations"}, "INTEL_FAST": INTELLIGENT | {"clusters", "cluster_members"}, "INTEL_SECURITY": INTELLIGENT, "INTEL_COMPLIANCE": INTELLIGENT | {"relations"},
    "INTEL_OILFIELD": INTELLIGENT | {"relations"}, "DEDUP": EVERYWHERE | {"clusters", "cluster_members"},
}


@pytest.mark.parametrize("profile", TABLES)
def test_profiles(spark, tmp_path, profile):
    out = str(tmp_path / "out")
    r = pipeline.run(spark, [str(planted(tmp_path))], out, 1, "2030-01-01 00:00:00", profile)
    assert {p.name for p in (tmp_path / "out").iterdir()} - {"events"} == TABLES[profile]
    assert r.files.count() == 5 and all(history.read_scans(spark, f"{out}/{t}").where("scan_id <> 1").count() == 0 for t in TABLES[profile])
    states = {s["stage"]: s for s in history.states(spark.read.parquet(f"{out}/events")).collect()}
    assert {s["status"] for s in states.values()} == {"completed"} and all(s["completed_at"] >= s["started_at"] for s in states.values())
    assert {"scan", "discovery", "classification", "recommendations"} <= set(states) and ("deduplication" in states) is ("clusters" in TABLES[profile])
    categories = {x["category"] for x in r.recommendations.collect()}
    assert ("delete" in categories) is ("clusters" in TABLES[profile])
    if profile == "DEDUP":
        assert categories == {"delete"}


def test_scan_end_to_end(spark, tmp_path):
    src = planted(tmp_path)
    r = pipeline.scan(spark, [str(src)], 1, "2030-01-01 00:00:00")
    assert r.files.count() == r.classifications.count() == r.scores.count() == 5
    assert [(c["kind"], c["file_count"]) for c in r.clusters.collect()] == [("exact", 2)]
    assert sorted(m["is_keeper"] for m in r.cluster_members.collect()) == [False, True]
    assert {x["kind"] for x in r.relations.collect()} >= {"duplicates", "references", "depends_on"}
    assert r.classifications.where("domain = 'PROG' and score = 0.95").count() == 1
    assert "delete" in {x["category"] for x in r.recommendations.collect()}
    assert [f["name"] for f in r.functions.collect()] == ["run"] and "KEY_NAME" in {x["name"] for x in r.library.collect()} and "ValueError::no N" in {x["fingerprint"] for x in r.errors.collect()}
    assert sum(s["file_count"] for s in r.domain_stats.collect()) == 5 and r.summaries.count() >= 1
    # being named raises importance
    fast = {s["file_id"]: s["importance"] for s in pipeline.scan(spark, [str(src)], 9, "2030-01-01 00:00:00", "INTEL_FAST").scores.collect()}
    named = next(f["id"] for f in r.files.collect() if f["filename"] == "records.json")
    assert {s["file_id"]: s["importance"] for s in r.scores.collect()}[named] > fast[named]
    again = pipeline.scan(spark, [str(src)], 2, "2030-01-01 00:00:00", "INTEL_FAST", known=r.files)
    assert again.files.count() == 0 and again.scores.count() == 0 and again.relations is None
    hashes = lambda s: {x["file_id"]: x["determinism_hash"] for x in s.classifications.collect()}
    assert hashes(pipeline.scan(spark, [str(src)], 3, "2030-01-01 00:00:00", "INTEL_FAST")) == hashes(r)


def test_failed_and_cancelled_scans(spark, tmp_path, monkeypatch):
    src, out = planted(tmp_path), str(tmp_path / "out")
    monkeypatch.setattr(pipeline.scoring, "score_files", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pipeline.run(spark, [str(src)], out, 1, "2030-01-01 00:00:00")
    pipeline.cancel(spark, 2)
    with pytest.raises(pipeline.Cancelled):
        pipeline.run(spark, [str(src)], out, 2, "2030-01-01 00:00:00")
    states = {(s["scan_id"], s["stage"]): s for s in history.states(spark.read.parquet(f"{out}/events")).collect()}
    assert states[1, "scan"]["status"] == states[1, "scoring"]["status"] == "failed" and "ZeroDivisionError" in states[1, "scoring"]["detail"] and states[1, "discovery"]["status"] == "completed"
    assert states[2, "scan"]["status"] == "cancelled" and states[2, "scan"]["completed_at"] is not None
    assert len(history.event(1, "a", "failed", "x" * 5000)[4]) == history.LONGEST_DETAIL


def test_status_of_recommendations(spark):
    rows = spark.createDataFrame([("delete", 1), ("review", 2)], "category string, n int")
    changes = spark.createDataFrame([("delete", "accepted", 1), ("delete", "done", 2)], "category string, status string, at long")
    assert {r["category"]: r["status"] for r in history.with_status(rows, ["category"], changes).collect()} == {"delete": "done", "review": "open"}


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "out")
    main(["scan", str(planted(tmp_path)), "--tables", out, "--scan-id", "1"], spark)
    for command, said in (("status", "completed"), ("domains", "PROG"), ("duplicates", "exact"), ("recommendations", "delete"), ("report", "# Proposals")):
        main([command, "--tables", out], spark)
        assert said in capsys.readouterr().out
    main(["search", "records", "--tables", out], spark)
    assert "records.json" in capsys.readouterr().out
    main(["scan", str(tmp_path / "src"), "--tables", out, "--scan-id", "2", "--profile", "DEDUP", "--changed-since", "1"], spark)
    assert "scan 2: 0 files" in capsys.readouterr().out
    main(["queries"], spark)
    assert "c_scores" in capsys.readouterr().out


def test_active_sheet(tmp_path):
    cell = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="inlineStr"><is><t>{}</t></is></c></row></sheetData></worksheet>'
    book = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>'
    links = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet10.xml"/></Relationships>'
    for named, want in ((True, "ten"), (False, "one")):
        with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
            z.writestr("xl/worksheets/sheet10.xml", cell.format("ten"))
            z.writestr("xl/worksheets/sheet1.xml", cell.format("one"))
            if named:
                z.writestr("xl/workbook.xml", book)
                z.writestr("xl/_rels/workbook.xml.rels", links)
        assert samples.xlsx_sample(tmp_path / "x.xlsx") == want


def test_columns_of_databases_and_dotted_keys(tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE one (a, b)")
        db.execute("CREATE TABLE two (c)")
    assert samples.sqlite_columns(tmp_path / "a.db") == ["one", "two", "a", "b", "c"]
    assert samples.dotted_keys({"a": {"b": [{"c": 1}, {"d": 2}]}, "e": [], "f": 1}) == ["a", "a.b", "a.b[0].c", "e", "f"]
    assert samples.nesting({}) == samples.nesting(1) == samples.nesting([]) == 0 and samples.nesting({"a": {"b": [{"c": 1}]}}) == 4
