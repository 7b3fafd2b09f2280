"""Small tables for the tests."""

from __future__ import annotations

FILES = "id long, path string, filename string, extension string, size_bytes long, created_at string, modified_at string, accessed_at string, sha256 string, content_sample string, mime_type string, parent_dir string, depth int, is_binary int"
DEFAULTS = {"size_bytes": 1024, "created_at": None, "modified_at": "2026-02-27T00:00:00Z", "accessed_at": "2026-02-27T00:00:00Z", "sha256": None, "content_sample": None, "mime_type": None, "depth": 3, "is_binary": 0}
AS_OF = "2026-02-28 00:00:00"
CLASSES = "id long, file_id long, domain string, topic string, score double, authority_weight int, engine_id string"


def files(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        r = dict(r)
        r.setdefault("id", i + 1)
        r.setdefault("filename", f"file_{r['id']}.txt")
        r.setdefault("parent_dir", r"O:\test")
        r.setdefault("path", rf"{r['parent_dir']}\{r['filename']}")
        r.setdefault("extension", "." + r["filename"].rsplit(".", 1)[1].lower() if "." in r["filename"] else "")
        out.append(tuple((DEFAULTS | r)[c.split()[0]] for c in FILES.split(", ")))
    return spark.createDataFrame(out, FILES)


def classes(spark, *rows):
    return spark.createDataFrame([(i + 1, f, d, t, s, 80, "PROG01") for i, (f, d, t, s) in enumerate(rows)], CLASSES)


def digest(c):
    return c * 64
