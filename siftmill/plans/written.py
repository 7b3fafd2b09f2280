"""Queries again over a few written rows, for what the test tables hold nothing of: patterns, routes, prompts, errors, imports, JSON, semantic copies.

The rows are tables of their own in the shared folder for Spark and ``VALUES`` that take the place of the tables for SQL. Where
SQL can't express a query, the rows that it must give are written down.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..session import shared_dir
from .catalog import QUERIES, SQL, query, s

FILES = "id bigint, path string, filename string, extension string, size_bytes bigint, created_at string, modified_at string, accessed_at string, sha256 string, xxhash string, mime_type string, drive string, parent_dir string, depth int, is_binary int, content_sample string, scan_id bigint"
CODE = "file_id bigint, path string, extension string, language string, content string, size_bytes bigint"
CLASSES = "id bigint, file_id bigint, scan_id bigint, engine_id string, domain string, topic string, authority_weight int, score double"
SCORES = "id bigint, file_id bigint, scan_id bigint, overall_score double, quality_score double, importance_score double, sensitivity_score double, staleness_score double, uniqueness_score double, risk_score double, primary_domain string, primary_engine string, domain_distribution string, classification_count int, scored_at timestamp, score_version string"

ASSISTANT = "You are a careful assistant who answers in short and full sentences."
SERVICE = f'''import os
from fastapi import FastAPI
import argparse
system_prompt = "{ASSISTANT}"
MAX_ROWS: int = 5
key = '{"AI" + "za" + "c" * 35}'
_instance = None
class Row(BaseModel):
    x: int
class Part(TypedDict):
    y: int
SCHEMA = 'CREATE TABLE IF NOT EXISTS rows (a int);'
@app.get('/rows')
async def rows(a: int, /, b: str = 'x', *more: float, c: bool, **rest: object) -> None:
    """All rows."""
    try:
        retry_with_backoff(os.environ['ROW_HOST'])
    except ValueError:
        log(1)
    # TODO: throttle
def main():
    raise TimeoutError('no answer after 30 s')
Traceback (most recent call last):
  File "a", line 1
    x
KeyError: 'k'
if __name__ == '__main__':
    main()
'''
TOOL = "import os\nimport fastapi\nclass Tool:\n    def run_tool(self, *args):\n        # FIXME: argparse\n        return os.environ.get('TOOL_HOME')\ndef main():\n    pass\n"
SCRIPT = f'const api = require("express");\nimport {{ a }} from "./helper";\ninterface Row {{ a: string }}\nrouter.post(`/rows`, h);\nrouter.post(\'/rows\', h);\nm = {{"role": "system", "content": "{ASSISTANT}"}};\ntry {{ go(process.env.API_HOST) }} catch (e) {{ log(e) }}\nif (bad) {{ throw new TypeError(\'no 12\'); }}\nconsole.error(\'failed to load\');\nasync function render(row, to) {{\n  return row;\n}}\nconst shown = (x) => render(x, 1);\n'
TYPED = "def sample(a: int, /, b: str = 'x', *more: float, c: bool, **rest: object) -> None:\n    'Doc.'\n    create_pool = ThreadPool(1)\n    return 1\n\nasync def two():\n    try:\n        pass\n    except E:\n        pass\n"
LOG = "10:00 ERROR | TimeoutError: no answer after 30 s\n10:01 ERROR | TimeoutError: no answer after 45 s\nCRITICAL: disk full\nstatus_code=503 x message: 'down'\nHTTP: 404 detail=gone\nINFO: fine\n"
SETTINGS = '{"server": {"host": "a", "ports": [{"in": 1}, {"out": 2}]}, "debug": true}'
_WORDS = "river stone garden window paper tower harbour meadow lantern orchard copper violet".split()


def _file(i: int, name: str, text: str, place: str = "O:\\work", size: int | None = None, day: int = 1) -> tuple:
    ext = "." + name.rsplit(".", 1)[1] if "." in name else ""
    digest = hashlib.sha256(text.encode()).hexdigest()
    return (i, f"{place}\\{name}", name, ext, len(text) if size is None else size, "2026-01-01T00:00:00Z", f"2026-02-{day:02d}T00:00:00Z", "2026-03-01T00:00:00Z", digest, digest[:16], "text/plain", place[:2], place, place.count("\\") + 1, 0, text, 1)


def _notes() -> list[tuple]:
    """Notes of mostly the same words: each shares eleven of twelve with its neighbours, and nine at most with those beyond."""
    return [_file(100 + i, f"note_{i}.txt", " ".join(_WORDS[j] if j >= i else _WORDS[j] + "es" for j in range(12)) + "!" * i, "O:\\notes", day=1 + i) for i in range(5)]


ROWS = {
    "files": (FILES, [
        _file(1, "service.py", SERVICE, size=20_000), _file(2, "tool.py", TOOL), _file(3, "script.ts", SCRIPT), _file(4, "helper.ts", "export const a = 1;\n"), _file(5, "run.log", LOG), _file(6, "settings.json", SETTINGS),
        _file(7, "os.py", "x = 1\n"), _file(8, "helper copy.ts", "export const a = 1;\n", day=9), _file(9, "one.txt", "Nearly the same, twice.", day=3), _file(10, "two.txt", "nearly the SAME twice", day=4), *[_file(20 + i, f"table_{i}.csv", f"a,b\n{i},2\n", "O:\\data", day=2 + i) for i in range(7)], *_notes(),
    ]),
    "code_files": (CODE, [(1, "service.py", ".py", "python", SERVICE, 20_000), (2, "tool.py", ".py", "python", TOOL, 900), (3, "script.ts", ".ts", "typescript", SCRIPT, 900), (8, "copy.py", ".py", "python", TOOL, 900), (9, "broken.py", ".py", "python", "def broken(\n", 12), (10, "typed.py", ".py", "python", TYPED, 300)]),
    "classifications": (CLASSES, [(i, i, 1, "PROG01", "PROG", "scripts", 80, 0.9) for i in (1, 2, 3)] + [(20 + i, 20 + i, 1, "FIN01", "FINANCE", "tables", 80, 0.8) for i in range(7)] + [(100 + i, 100 + i, 1, "LG01", "LEGAL", "notes", 70, 0.7) for i in range(5)]),
    "intelligence_scores": (SCORES, [(20 + i, 20 + i, 1, 50.0, 50.0, 50.0, 10.0, 10.0, 90.0, 10.0, "FINANCE", "FIN01", "{}", 1, datetime(2026, 3, 1), "1") for i in range(7)]),
}


def _literal(value: object) -> str:
    return "NULL" if value is None else s(str(value)) if isinstance(value, datetime) else s(value)


def _values(name: str) -> str:
    schema, rows = ROWS[name]
    columns = [c.split() for c in schema.split(", ")]
    typed = ", ".join(f"CAST({c} AS {'VARCHAR' if t == 'string' else t}) AS {c}" for c, t in columns)
    names = ", ".join(c for c, _ in columns)
    given = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) or "(" + ", ".join(["NULL"] * len(columns)) + ")"
    return f"{name} AS (SELECT {typed} FROM (VALUES {given}) AS t({names}){'' if rows else ' WHERE false'})"


def over_values(sql: str) -> str:
    """A query of SQL with the written rows in the place of the tables."""
    return f"WITH {', '.join(map(_values, ROWS))} SELECT * FROM ({sql})"


def written(spark: SparkSession) -> str:
    """The folder with the written rows as tables, made once in the shared folder."""
    key = hashlib.sha256(json.dumps(ROWS, default=str).encode()).hexdigest()[:16]
    folder = f"{shared_dir(spark).rstrip('/')}/siftmill-written-{key}"
    for name, (schema, rows) in ROWS.items():
        path = f"{folder}/{name}.parquet"
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            spark.createDataFrame(rows, schema.replace("bigint", "long")).coalesce(1).write.mode("overwrite").parquet(path)
    return folder


def again(name: str, rows: str | None = None) -> None:
    """Register ``name`` over the written rows as ``w_…``; ``rows`` is SQL for what it must give where it has none of its own."""
    sql = over_values(SQL[name]) if rows is None else rows

    @query(f"w_{name}", sql)
    def over_written_rows(spark: SparkSession, d: str) -> DataFrame:
        out = QUERIES[name](spark, written(spark))
        lists = [c for c, kind in out.dtypes if kind == "array<string>"]
        return out.withColumns({c: F.array_join(c, " ") for c in lists}) if lists else out


def _body_hash(body: str) -> str:
    return hashlib.md5(" ".join(body.split()).encode()).hexdigest()[:16]


#: The functions of the written Python files that compile: name, body, files that hold it.
BODIES = [
    ("main", "def main():\n    pass", 2), ("run_tool", "def run_tool(self, *args):\n    # FIXME: argparse\n    return os.environ.get('TOOL_HOME')", 2),
    ("sample", TYPED.split("\n\n")[0], 1), ("two", TYPED.split("\n\n")[1].rstrip("\n"), 1),
]
_L1 = "id BIGINT, name VARCHAR, line_number INT, signature VARCHAR, docstring VARCHAR, body VARCHAR, body_hash VARCHAR, arg_count INT, is_async BOOLEAN, quality INT, patterns VARCHAR"
_L1_ROWS = [
    *[(i, n, line, sign, "", b, _body_hash(b), args, False, 5, "") for i in (2, 8) for (n, b, _), line, sign, args in ((BODIES[0], 7, "def main()", 0), (BODIES[1], 4, "def run_tool(self, *args)", 2))],
    (10, "sample", 1, "def sample(a: int, /, b: str, *more: float, c: bool, **rest: object) -> None", "Doc.", BODIES[2][1], _body_hash(BODIES[2][1]), 5, False, 65, "pool"),
    (10, "two", 6, "async def two()", "", BODIES[3][1], _body_hash(BODIES[3][1]), 0, True, 25, ""),
]


def expect(name: str, columns: str, *rows: tuple) -> None:
    """``again`` for a query that SQL can't express, with the rows that it must give."""
    typed = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in (x.split() for x in columns.split(", ")))
    given = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    again(name, f"SELECT {typed} FROM (VALUES {given}) AS t({', '.join(x.split()[0] for x in columns.split(', '))})")


expect("l1_python_functions", _L1, *_L1_ROWS)
expect("l2_copy_counts", "body_hash VARCHAR, name VARCHAR, copies BIGINT", *[(_body_hash(b), n, k) for n, b, k in BODIES])
expect("l13_most_copied_functions", "body_hash VARCHAR, name VARCHAR, copies BIGINT", *[(_body_hash(b), n, k) for n, b, k in BODIES])
expect("m1_code_structure", "id BIGINT, functions VARCHAR, classes VARCHAR, imports VARCHAR, has_async BOOLEAN, has_types BOOLEAN, has_docs BOOLEAN", (1, "", "", "", False, False, False), (2, "main run_tool", "Tool", "os fastapi", False, False, False), (3, "render shown", "", "", False, False, False), (8, "main run_tool", "Tool", "os fastapi", False, False, False), (9, "", "", "", False, False, False), (10, "sample two", "", "", True, True, True))
expect("a11_framework_counts", "framework VARCHAR, occurrences BIGINT", ("fastapi", 2))
expect("m2_json_settings", "id BIGINT, keys VARCHAR, depth INT, has_env BOOLEAN", (6, "server server.host server.ports server.ports[0].in debug", 4, False))
expect("d3_semantic_clusters", "cluster VARCHAR, file_count BIGINT, keeper_id BIGINT, wasted_bytes BIGINT", ("sem:LEGAL:notes:101", 2, 102, 85), ("sem:LEGAL:notes:103", 2, 104, 91))
expect("m4_assimilated", "kind VARCHAR, files BIGINT, keys BIGINT", ("code", 6, 15), ("config", 1, 5))
expect("f5_json_keys", "id BIGINT, keys VARCHAR, depth INT", (6, "server debug host ports in out", 4))
_HELPER, _NEAR = "export const a = 1;\n", "nearly the same twice"
expect(
    "d0_all_duplicates", "kind VARCHAR, cluster VARCHAR, file_count BIGINT, keeper_id BIGINT, wasted_bytes BIGINT", ("exact", hashlib.sha256(_HELPER.encode()).hexdigest(), 2, 8, len(_HELPER)),
    ("near", "near:" + hashlib.sha256(_NEAR.encode()).hexdigest()[:32], 2, 10, len(_NEAR) + 2), ("semantic", "sem:LEGAL:notes:101", 2, 102, 85), ("semantic", "sem:LEGAL:notes:103", 2, 104, 91),
)
expect(
    "d0_all_members", "kind VARCHAR, cluster VARCHAR, file_id BIGINT, is_keeper BOOLEAN", *[("exact", hashlib.sha256(_HELPER.encode()).hexdigest(), i, i == 8) for i in (4, 8)], *[("near", "near:" + hashlib.sha256(_NEAR.encode()).hexdigest()[:32], i, i == 10) for i in (9, 10)],
    *[("semantic", f"sem:LEGAL:notes:{n}", i, i != n) for n in (101, 103) for i in (n, n + 1)],
)

for _name in [
    "l4_masked_secrets", "l5_design_patterns", "l6_schemas", "l7_endpoints", "l8_prompts", "l9_settings", "l10_error_handlers", "l11_credential_uses", "l12_all_but_functions", "l3_script_functions", "e2_errors", "e3_errors_in_code",
    "e5_error_patterns", "e5_top_patterns", "k10_new_library_rows", "e5_new_error_patterns", "r4_depends_on", "d3_semantic_links", "prop1_domains", "prop3_partial_projects", "prop6_large_scripts", "prop8_completions",
]:
    again(_name)
