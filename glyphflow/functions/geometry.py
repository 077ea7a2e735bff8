"""Boxes, polygons and offsets as expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The rectangle within the frame, or null if nothing is left."""
    x1, y1, x2, y2 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0)), F.least(x + w, width), F.least(y + h, height)
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def offset(kind: Column, points: Column, full_frame: Column) -> Column:
    """(dx, dy) of a region from its points as JSON: rectangles as they are, polygons by their least x and y; else null."""
    rect, poly = F.from_json(points, "array<int>"), F.from_json(points, "array<array<int>>")
    pair = lambda a, b: F.struct(a.alias("dx"), b.alias("dy"))
    low = lambda k: F.array_min(F.transform(poly, lambda p: F.get(p, k)))
    return F.when(full_frame, pair(F.lit(0), F.lit(0))).when((kind == "rect") & (F.size(rect) >= 2), pair(F.get(rect, 0), F.get(rect, 1))).when((kind == "poly") & (F.size(poly) >= 2), pair(low(0), low(1)))


def shift_polygons(polys: Column, dx: Column, dy: Column) -> Column:
    """Points of two numbers move; others stay."""
    return F.transform(polys, lambda p: F.transform(p, lambda q: F.when(F.size(q) == 2, F.array(F.get(q, 0) + dx, F.get(q, 1) + dy)).otherwise(q)))


def shift_boxes(boxes: Column, dx: Column, dy: Column) -> Column:
    return F.transform(boxes, lambda b: F.when(F.size(b) == 4, F.array(F.get(b, 0) + dx, F.get(b, 1) + dy, F.get(b, 2) + dx, F.get(b, 3) + dy)).otherwise(b))


def centre(polygon: Column) -> Column:
    mean = lambda k: F.when(F.size(polygon) > 0, F.aggregate(polygon, F.lit(0.0), lambda s, p: s + F.get(p, k)) / F.size(polygon)).otherwise(0.0)
    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


def height(polygon: Column) -> Column:
    ys = F.transform(polygon, lambda p: F.get(p, 1))
    return F.coalesce(F.array_max(ys) - F.array_min(ys), F.lit(0))


def to_video(p: Column, shift: Column, scale: Column) -> Column:
    """A screen coordinate in video pixels, cut towards zero."""
    return ((p - shift) * scale).cast("int")
