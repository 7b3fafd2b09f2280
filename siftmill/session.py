"""Session construction and the shared working folder of a run."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "siftmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on: UTC, adaptive execution, Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by ``spark.checkpoint.dir``.

    Only where that setting is missing (a local session, as in tests) a folder on this machine is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"siftmill-{os.getuid()}"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application, so that it needn't be installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root, held = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_bytes())
    data = held.getvalue()
    path = f"{shared_dir(spark).rstrip('/')}/siftmill-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        out = files.create(place, True)
        out.write(bytearray(data))
        out.close()
    context.addPyFile(path)


def stored(df: DataFrame, name: str = "part", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and lost executors don't matter.

    Unlike a checkpoint the written table keeps column pruning and filter pushdown for its readers.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; removed when its driver ends."""
    application = spark.sparkContext.applicationId
    if application not in _OWNED:
        _OWNED.add(application)
        atexit.register(_forget_quietly, spark)
    return f"{shared_dir(spark).rstrip('/')}/siftmill/{application}"


_OWNED: set[str] = set()


def _forget_quietly(spark: SparkSession) -> None:
    try:
        forget(spark)
    except Exception:  # the session has been stopped: the folder stays until it is cleared
        pass


def forget(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application from the shared folder; those of other runs stay."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/siftmill/{spark.sparkContext.applicationId}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input that a core takes as it is; less makes fewer partitions than there are cores.
BYTES_PER_CORE = 4 << 20


def spread(df: DataFrame, by: str) -> DataFrame:
    """``df`` over all cores where its input is so small that it comes in fewer partitions than these.

    Judged by the bytes of the tables that are read, so nothing is run for it; larger inputs come as they are and are never
    shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df if size >= cores * BYTES_PER_CORE else df.repartition(cores, by)
