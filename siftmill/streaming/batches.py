"""Running a stream over what is there, and folding its micro-batches into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A Parquet table, a directory or a single file, as a stream of its files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path)


def stream_place(spark: SparkSession, name: str | None) -> str:
    """The folder of a stream in the shared folder: its own for ``name``, where it goes on on every run, else a new one."""
    return f"{shared_dir(spark).rstrip('/')}/siftmill-streams/{name or uuid.uuid4().hex}"


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "update", name: str | None = None) -> None:
    """Run a stream over all that is available and not yet done under ``name``, then end. ``sink`` gets each micro-batch and its number and must bear to get it twice."""
    place = f"{stream_place(stream.sparkSession, name)}/checkpoint"
    stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def last_states(stream: DataFrame, name: str | None = None) -> DataFrame:
    """Every update of a stream with the number of its batch, written per batch, so that a repeated batch replaces itself.

    Under a ``name`` a later run goes on where the last one ended and adds its updates to those before.
    """
    spark = stream.sparkSession
    name = name or uuid.uuid4().hex
    place = f"{stream_place(spark, name)}/states"
    run_available(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{place}/batch={n}"), name=name)
    return spark.read.parquet(place)


def clear(spark: SparkSession, name: str) -> None:
    """Forget what has been done under a name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(stream_place(spark, name))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
