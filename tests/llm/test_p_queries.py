"""The p queries over the smallest test data: against SQL where there is some, against brute force where not."""

import os
import re
from collections import Counter

import pytest

from siftmill.llm import queries as Q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data here")

COLUMNS = {
    "p1_found": {"primary_domain": "string", "domain_rank": "int", "id": "bigint"}, "p2_found": {"id_a": "bigint", "id_b": "bigint"}, "p3_found": {"file_id": "bigint", "name": "string", "line_number": "int"},
    "p4_found": {"sha256": "string", "keeper_id": "bigint", "path_id": "bigint", "mime_id": "bigint", "created_id": "bigint"}, "p5_found": {"id": "bigint", "line_number": "int"}, "p6_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p8_found": {"doc_id": "bigint"},
}


def pandas(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{DIR}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", Q.queries())
def test_runs(spark, name):
    df = Q.queries()[name](spark, DIR)
    rows = df.collect()
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    assert rows or name.startswith("p2")
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    result = db.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = Q.queries()[name](spark, DIR)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(result.fetchall()) and set(df.columns) == set(columns)


def test_p2_against_brute_force(spark):
    sets = {}
    for r in pandas("files"):
        w = re.findall("[a-z0-9_]+", (r["content_sample"] or "").lower())
        if len(w) >= 20:
            sets[r["id"]] = (r["xxhash"], set(zip(w, w[1:], w[2:])))
    ids = sorted(sets)
    want = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (ha, x), (hb, y) = sets[a], sets[b]
            if (ha is None or hb is None or ha != hb) and len(x & y) >= 0.6 * len(x | y):
                want.add((a, b))
    assert {tuple(r) for r in Q.p2_found(spark, DIR).collect()} == want


def test_p7_keeps_its_promises(spark):
    mixed = Q.p7_mix(spark, DIR).collect()
    docs = {r["doc_id"]: r for r in pandas("documents")}
    caps = {r["source"]: r["max_repeats"] for r in pandas("source_weights")}
    used = Counter()
    for r in mixed:
        used[docs[r["doc_id"]]["text"]] += r["copies"]
        assert 1 <= r["copies"] <= caps[r["source"]] and docs[r["doc_id"]]["source"] == r["source"]
    assert max(used.values()) <= max(caps.values())
    shares = {r["source"]: r for r in Q.p7_shares(spark, DIR).collect()}
    longest = max(r["n_tokens"] for r in mixed)
    assert set(shares) == set(caps) and all(abs(r["actual_tokens"] - r["budget_tokens"]) < longest for r in shares.values())
