"""Sharding along a Hilbert curve.

Rows are points in a grid of several metadata columns, each cut at its quantiles, and go by their place on the Hilbert
curve through that grid, which keeps cells near each other that are near in all columns. The order is cut into shards,
and a shard into runs, so that each run covers a small box: ``manifest`` has the bounds of every run, and ``overlapping``
names the runs that a condition on some of the columns can't rule out.

The order is made by one range shuffle and a sort, so a task holds what it sorts (and spills). Rows of one cell, a third of
all or more, differ by a hash and a number, so they are dealt to as many tasks as their share needs. The driver sees the
quantiles and one row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glyphflow.llm._common import stored

BITS = 6  # of each column: 64 steps
ADDED = ("curve", "law", "shard", "slot", "run")


def coordinate(df: DataFrame, name: str) -> Column:
    """A number in the order of the column: of texts the first seven bytes, of times the seconds; nulls stay nulls."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("string", "binary") or kind.startswith(("char", "varchar")):
        start = F.hex(F.substring(c.cast("binary"), 1, 7))
        return F.conv(F.rpad(start, 14, "0"), 16, 10).cast("double")
    if kind.startswith("timestamp"):
        return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def quantiles(points: DataFrame, names: list[str], bits: int) -> list[list[float]]:
    """The inner edges of 2**bits parts of about as many rows, for each column."""
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = points.agg(*(F.percentile_approx(n, at, 10_000).alias(n) for n in names)).first()
    return [[*(found[n] or [])] for n in names]


def places(cells, bits: int):
    """The place of each cell on the curve: ``cells`` is a list of integer arrays, one for each dimension."""
    import numpy as np

    x = [np.asarray(c, np.int64).copy() for c in cells]
    for b in range(bits - 1, 0, -1):  # turn and mirror the sub-cubes, from the largest down
        q, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            far = (x[i] & q) != 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(far, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):  # Gray code across the dimensions
        x[i] ^= x[i - 1]
    odd = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        odd ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | (((v ^ odd) >> b) & 1)
    return out


def _with(schema: StructType, *longs: str) -> StructType:
    return StructType([*schema.fields, *(StructField(n, LongType()) for n in longs)])


def _placed(rows: DataFrame, dims: int, edges: list[list[float]], bits: int) -> DataFrame:
    """Replaces the coordinates d0, d1, ... by ``curve``; a null is in a column's first part."""
    schema = rows.drop(*(f"d{i}" for i in range(dims))).schema
    kept, names = schema.names, [*schema.names, "curve"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            cells = []
            for i in range(dims):
                v = batch.column(f"d{i}").to_numpy(zero_copy_only=False)
                cells.append(np.where(np.isnan(v), 0, np.searchsorted(np.asarray(edges[i], np.float64), v, "left")))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(places(cells, bits))], names=names)

    return rows.mapInArrow(run, _with(schema, "curve"))


def _counted(sorted_rows: DataFrame) -> DataFrame:
    """Adds part, before_rows and before_bytes: the partition, and what stands before a row in it (in order of reading)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, rows, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n, sizes = batch.num_rows, batch.column("_size").to_numpy(zero_copy_only=False)
            to = np.cumsum(sizes, dtype=np.int64)
            more = [np.full(n, part, np.int64), np.arange(rows, rows + n, dtype=np.int64), size + to - sizes]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], names=[*batch.schema.names, "part", "before_rows", "before_bytes"])
            rows, size = rows + n, size + int(to[-1]) if n else size

    return sorted_rows.mapInArrow(run, _with(sorted_rows.schema, "part", "before_rows", "before_bytes"))


def layout(rows: DataFrame, dims: list[str], shards: int, law: str = "rows", size: Column | None = None, bits: int = BITS, run_rows: int = 100_000) -> DataFrame:
    """The rows with curve, law, shard (from 0), slot (gapless from 0 in a shard, along the curve) and run (of ``run_rows``
    slots).

    ``dims`` are columns of numbers, texts, times or dates, with at most 62 bits together. ``law`` says what the shards are
    cut by: "rows" (counts at most one apart) or "bytes" (sums of ``size``, a positive number, each within the largest row
    of an even share). Columns that have the names of new ones are replaced; others, whatever their names, stay. A null
    is in the first part of its column; equal rows are rows of their own, in any order. No rows give no rows; with fewer
    rows than shards some shards are empty.
    """
    if law not in ("rows", "bytes") or not dims or len(dims) * bits > 62:
        raise ValueError("law is rows or bytes, and dims are one column or more, of 62 bits together at most")
    spark, given = rows.sparkSession, [c for c in rows.columns if c not in ADDED]
    size = F.lit(1).cast("long") if size is None else size.cast("long")
    points = rows.select(F.struct(*(f"`{c}`" for c in given)).alias("row"), size.alias("_size"), *(coordinate(rows, d).alias(f"d{i}") for i, d in enumerate(dims)))
    points = stored(points.withColumn("uid", F.monotonically_increasing_id()), "points")
    edges = quantiles(points, [f"d{i}" for i in range(len(dims))], bits)
    placed = _placed(points, len(dims), edges, bits).withColumn("tie", F.xxhash64("uid"))
    ordered = stored(_counted(placed.repartitionByRange("curve", "tie", "uid").sortWithinPartitions("curve", "tie", "uid")), "ordered")

    # one row for each partition, in order
    sums = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).orderBy("part").collect()
    first, n, b = [], 0, 0
    for s in sums:
        first.append((s.part, n, b))
        n, b = n + s.n, b + s.b
    parts = spark.createDataFrame(first, "part long, first_rows long, first_bytes long")
    ranked = ordered.join(F.broadcast(parts), "part").withColumn("rank", F.col("first_rows") + F.col("before_rows"))
    div = lambda x, by: F.call_function("div", x, F.lit(by).cast("long"))
    whole = lambda c: c.cast("decimal(38,0)")
    if law == "rows":
        shard = div(F.col("rank") * shards, max(n, 1))
        ranked = ranked.withColumn("shard", shard.cast("int")).withColumn("opens", div(F.col("shard") * F.lit(n) + F.lit(shards - 1), shards))
    else:
        at = whole(F.col("first_bytes") + F.col("before_bytes")) * shards
        ranked = ranked.withColumn("shard", F.call_function("div", at, whole(F.lit(max(b, 1)))).cast("int"))
        opens = ranked.groupBy("shard").agg(F.min("rank").alias("opens"))  # one row for each shard
        ranked = ranked.join(F.broadcast(opens), "shard")
    slot = F.col("rank") - F.col("opens")
    return ranked.select("row.*", "curve", F.lit(law).alias("law"), "shard", slot.alias("slot"), div(slot, run_rows).alias("run"))


def write(laid: DataFrame, path: str) -> None:
    """Files by shard and run, rows in order. A partition of the layout holds neighbours, so it writes to few of them."""
    laid.sortWithinPartitions("shard", "slot").write.partitionBy("shard", "run").parquet(path)


def manifest(laid: DataFrame, dims: list[str]) -> DataFrame:
    """shard, run, n_rows, and lo_, hi_, nulls_ of each column: what a reader has to know to leave runs out."""
    bounds = [f(f"`{d}`").alias(f"{side}_{d}") for d in dims for side, f in (("lo", F.min), ("hi", F.max))]
    nulls = [F.count_if(F.col(f"`{d}`").isNull()).alias(f"nulls_{d}") for d in dims]
    return laid.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n_rows"), *bounds, *nulls)


def overlapping(bounds: DataFrame, between: dict[str, tuple]) -> DataFrame:
    """The rows of a manifest whose runs may hold rows with each column of ``between`` in its closed range."""
    for d, (lo, hi) in between.items():
        bounds = bounds.where((F.col(f"`lo_{d}`") <= F.lit(hi)) & (F.col(f"`hi_{d}`") >= F.lit(lo)))
    return bounds
