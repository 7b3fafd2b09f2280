import os
import subprocess
import sys

from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from siftmill.session import build_session
from siftmill.sources.filetree import read_tree
from siftmill.sources.samples import sampled
spark = build_session(master="local[2]")
rows = sampled(read_tree(spark, [{tree!r}])).collect()
assert [r["filename"] for r in rows] == ["a.txt"] and rows[0]["sha256"] and not rows[0]["error"], rows
"""


def test_workers_get_the_package(tmp_path):
    """From a place from which the workers can't import it."""
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.txt").write_text("text")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, tree=str(tmp_path / "tree"))], cwd=tmp_path, env=env, check=True, timeout=120)


def test_only_small_inputs_are_spread(spark, tmp_path, monkeypatch):
    from siftmill import session

    spark.range(1000).selectExpr("id", "repeat('x', 100) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select("id")
    shuffled = lambda d: "RepartitionByExpression" in d._jdf.queryExecution().toString()
    assert shuffled(session.spread(df, "id")) and shuffled(session.spread(df.join(df.withColumnRenamed("id", "k"), df["id"] == F.col("k")), "id"))
    monkeypatch.setattr(session, "BYTES_PER_CORE", 100)
    assert not shuffled(session.spread(df, "id"))
