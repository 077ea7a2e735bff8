"""Tables between steps that several later steps read: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[str] = []  # what was staged and isn't deleted yet


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in local mode, where one process does everything, else a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = known.get() if known.isDefined() else _own_folder()
    return found.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="glyphflow-")


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete everything staged: for when results are written and nothing reads it any more."""
    while _left:
        at = spark._jvm.org.apache.hadoop.fs.Path(_left.pop())
        at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python tasks take ``rows`` rows at a time, unless the session has another number than Spark's own: a batch is
    held whole, as Arrow and as Python's objects, so what a worker holds would grow until partitions fill a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
