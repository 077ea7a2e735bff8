"""Helpers shared by the corpus operators: durable cuts of lineage and row keys."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    On a cluster this is ``spark.checkpoint.dir``, and without that setting an error is raised. Only in local mode
    (tests, a laptop), where one process does everything, a temporary folder of this machine stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="glyphflow-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: for tables that several later steps read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._stored_at = path
    _left.append(path)
    return read


_left: list[str] = []  # what ``stored`` wrote and nothing deleted yet


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)
    if path in _left:
        _left.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that results still read: for when the results are written and nothing is read any more."""
    for path in list(_left):
        _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None) if df is not None else None
        if path:
            _delete(df.sparkSession, path)


def standing() -> list[str]:
    """What ``stored`` has written so far and nothing deleted."""
    return list(_left)


def clear_since(spark: SparkSession, before: list[str], *but: DataFrame) -> None:
    """Delete what was stored after ``before`` (of ``standing``), except ``but``: for when these are written, and what they
    were made from is read no more."""
    keep = {*before, *(getattr(df, "_stored_at", None) for df in but)}
    for path in [p for p in _left if p not in keep]:
        _delete(spark, path)


def folded(rows: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """``run`` over each group of a key, as one Arrow table; groups are bounded, and a task holds one or two."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        for batch in batches:
            name = batch.column(0).to_numpy()
            cuts = [0, *(np.nonzero(name[1:] != name[:-1])[0] + 1).tolist(), len(name)] if len(name) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0].as_py() != name[a]:
                    yield from run(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(fold, schema)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python tasks take ``rows`` rows at a time, unless the session has another number than Spark's own: a batch
    is held whole on both sides, and texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_sample(rows: DataFrame, rank: str, most: int) -> DataFrame:
    """One row for each of ``most`` values of ``rank`` (a 64-bit hash of what must be distinct), or of all if there are
    fewer. Rows of all but about twice as many are left out, by another hash, before any is sent on, so what gathers
    stays bounded however many tasks read; the lowest of the others stay."""
    total = rows.select(rank).distinct().count()
    if total > 2 * most:
        rows = rows.where(F.pmod(F.xxhash64(rank), F.lit(1 << 30)) < int((1 << 30) * 2 * most / total))
    return rows.dropDuplicates([rank]).orderBy(rank).limit(most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Words of a licence, benchmark or document: runs of characters that are not ASCII punctuation, space or controls.
WORD_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
