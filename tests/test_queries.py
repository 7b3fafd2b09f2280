"""Every registered query over the smallest test data, against its SQL where it has some."""

import math
import os
import re
import shutil
import subprocess
import sys
import tempfile
from collections import Counter

import pytest

from siftmill.plans.all import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list) else v.isoformat()[:26] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    rows = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in SQL:
        result = db.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        at = [columns.index(c) for c in sorted(columns)]
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())


@data
def test_entry(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_stands_without_the_problems():
    code = "import __spark_entry__ as e\nassert e.queries() and not any(n[0] == 'p' and n[1].isdigit() for n in e.queries())"
    with tempfile.TemporaryDirectory() as place:
        shutil.copytree(os.path.join(ROOT, "siftmill"), os.path.join(place, "siftmill"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), place)
        subprocess.run([sys.executable, "-c", code], cwd=place, check=True)
    for folder, _, names in os.walk(os.path.join(ROOT, "siftmill")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"\bllm\b", f.read())
