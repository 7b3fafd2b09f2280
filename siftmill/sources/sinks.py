"""Where results go besides tables: JSON lines, text reports, and whether there is room for them."""

from __future__ import annotations

import json
import os
import shutil
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRITICAL, WARNING = 95.0, 85.0


def write_json(rows: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Rows as lines of JSON, about ``per_file`` to a file; nothing is overwritten."""
    rows.write.mode("error").option("maxRecordsPerFile", per_file).json(path)


def chunks(rows: DataFrame, order: str, size: int = 500) -> DataFrame:
    """Rows with the number of the chunk they are sent in: ranges of ``order`` are numbered one after the other, without sorting all rows in one task.

    Chunks have ``size`` rows but for the last of each range.
    """
    from pyspark.sql import Window

    ranged = rows.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return ranged.withColumn("chunk", F.struct(F.col("__part").alias("range"), F.floor(place / size).alias("nth"))).drop("__part")


def storage_summary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(anchor, total_bytes, free_bytes, used_pct, status) of the drives that some paths are on, each once."""
    seen: dict[tuple[int, int], tuple] = {}
    for path in paths:
        at = os.path.abspath(path)
        while not os.path.exists(at):
            at = os.path.dirname(at)
        usage = shutil.disk_usage(at)
        seen.setdefault((os.stat(at).st_dev, usage.total), (at, usage.total, usage.free, 100.0 * usage.used / usage.total))
    rows = spark.createDataFrame(list(seen.values()), "anchor string, total_bytes long, free_bytes long, used_pct double")
    return rows.withColumn("status", F.when(F.col("used_pct") >= CRITICAL, "critical").when(F.col("used_pct") >= WARNING, "warning").otherwise("available"))


def enough_room(path: str, least_gb: float = 5.0) -> bool:
    return shutil.disk_usage(path).free >= least_gb * 1024**3


def audit(spark: SparkSession, path: str, action: str, **facts: object) -> None:
    """Add one line of JSON to an audit log: what was done, when, and facts about it."""
    row = json.dumps({"at": datetime.now(UTC).isoformat(), "action": action, **facts}, default=str, sort_keys=True)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(path)
