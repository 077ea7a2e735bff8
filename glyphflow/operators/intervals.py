"""Intervals of frames: bounds, counts, unions and the join of frames with what is active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def clamp(rois: DataFrame, total: int, start: str = "start", end: str = "end") -> DataFrame:
    """Bounds within 0 and total - 1, swapped if reversed."""
    held = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(total - 1))
    return rois.withColumns({"_a": held(start), "_b": held(end)}).withColumns({start: F.least("_a", "_b"), end: F.greatest("_a", "_b")}).drop("_a", "_b")


def planned(rois: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Frames to visit, each interval counted by itself."""
    return rois.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rois"), F.sum(F.col(end) - F.col(start) + 1).cast("long").alias("planned"))


def union_count(rois: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Distinct frames covered. Starts and ends are summed by frame first, so the sweep orders frames, not intervals."""
    steps = rois.select(*by, F.explode(F.array(F.struct(F.col(start).alias("f"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("f"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(*by, F.col("s.f").alias("f")).agg(F.sum("s.d").alias("d"))
    w = W.partitionBy(*by).orderBy("f")
    active = steps.select(*by, "f", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("n"), F.lead("f").over(w).alias("then"))
    return active.groupBy(*by).agg(F.sum(F.when(F.col("n") > 0, F.col("then") - F.col("f")).otherwise(0)).cast("long").alias("covered"))


BASE, LEVELS = 16, 6  # cells of 16, 16**2, ... frames


def cells_of(start: Column, end: Column) -> Column:
    """array of (level, cell): an interval of frames as the fewest whole cells, at most 30 a level (more only of the largest
    size); every frame of it lies in exactly one of them."""
    parts, none = [], F.expr("cast(array() as array<struct<level:int,cell:long>>)")
    first = lambda size: F.ceil(start / F.lit(size))  # noqa: E731  the first cell that begins within, and the last that ends within
    last = lambda size: F.floor((end + 1) / F.lit(size)) - 1
    named = lambda level, a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda c: F.struct(F.lit(level).alias("level"), c.cast("long").alias("cell")))).otherwise(none)
    for level in range(LEVELS):
        a, b = first(BASE**level), last(BASE**level)
        if level == LEVELS - 1:
            parts.append(named(level, a, b))
        else:
            up, down = first(BASE ** (level + 1)), last(BASE ** (level + 1))
            inner = up <= down  # some of the next size lie within; these stand on either side of them
            parts += [named(level, a, F.when(inner, up * BASE - 1).otherwise(b)), F.when(inner, named(level, (down + 1) * BASE, b)).otherwise(none)]
    return F.when(start <= end, F.concat(*parts)).otherwise(none)


def cells_around(frame: Column) -> Column:
    """array of (level, cell): the cell of each size that a frame lies in."""
    return F.array(*(F.struct(F.lit(level).alias("level"), F.floor(frame / F.lit(BASE**level)).cast("long").alias("cell")) for level in range(LEVELS)))


def _cells(rois: DataFrame, start: str, end: str) -> DataFrame:
    return rois.withColumn("_c", F.explode(cells_of(F.col(start), F.col(end)))).withColumns({"_level": F.col("_c.level"), "_cell": F.col("_c.cell")}).drop("_c")


def _around(frames: DataFrame, frame: str) -> DataFrame:
    return frames.withColumn("_c", F.explode(cells_around(F.col(frame)))).withColumns({"_level": F.col("_c.level"), "_cell": F.col("_c.cell")}).drop("_c")


def frame_join(frames: DataFrame, rois: DataFrame, frame: str = "frame", start: str = "start", end: str = "end", on: tuple[str, ...] = ()) -> DataFrame:
    """Frames with every active interval (with equal ``on``, columns of both): an equi-join of cells.

    An interval is a few whole cells of frames, a frame looks up the six that it lies in, so nothing meets but what belongs
    together. Only the numbers of frames are looked up; their rows then join by them once.
    """
    at = [*on, frame]
    met = _around(frames.select(*at).distinct(), frame).join(_cells(rois, start, end), [*on, "_level", "_cell"]).drop("_level", "_cell")
    return frames.join(met, at)


def active_counts(frames: DataFrame, rois: DataFrame, key: str, frame: str = "frame", start: str = "start", end: str = "end", on: tuple[str, ...] = ()) -> DataFrame:
    """on, frame, active (how many intervals hold a frame), first_key (the least ``key`` of them), for frames in any.

    Intervals are summed up by cell first, so a frame meets six rows at most, however many intervals hold it.
    """
    cells = _cells(rois, start, end).groupBy(*on, "_level", "_cell").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("k"))
    met = _around(frames.select(*on, frame).distinct(), frame).join(cells, [*on, "_level", "_cell"])
    return met.groupBy(*on, frame).agg(F.sum("n").alias("active"), F.min("k").alias("first_key"))


def probe_frames(rois: DataFrame, by: list[str], most: int = 48, start: str = "start", end: str = "end") -> DataFrame:
    """Evenly spaced frames from the first start to the last end: between 8 and ``most``, no more than there are."""
    span = rois.groupBy(*by).agg(F.min(start).alias("lo"), F.max(end).alias("hi")).withColumn("n", F.least(F.greatest(F.lit(most), F.lit(8)), F.col("hi") - F.col("lo") + 1))
    at = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: F.floor(F.col("lo") + i * ((F.col("hi") - F.col("lo")) / (F.col("n") - 1))).cast("long"))).otherwise(F.array(F.col("lo").cast("long")))
    return span.select(*by, F.explode(F.array_distinct(at)).alias("frame"))
