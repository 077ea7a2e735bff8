"""Where groups stand, what is usual for their region, and which ones to leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphflow.functions import text as T
from glyphflow.operators.merge import upper_median, upper_median_of
from glyphflow.operators.segment import by_top, same_track, track_of

BOTTOM, TOP = 0.75, 0.15
SHARE, LOW, HIGH = 0.55, 0.65, 1.65


def mean_box(boxes: Column) -> Column:
    """The mean of each coordinate of boxes (x1, y1, x2, y2); null without any."""
    mean = lambda k: F.aggregate(boxes, F.lit(0.0), lambda s, b: s + F.get(b, F.lit(k))) / F.size(boxes)
    return F.when(F.size(boxes) > 0, F.array(*map(mean, range(4))))


def centre_y(lines: Column) -> Column:
    """The middle of the mean box of lines (``segment.LINE``); null without lines."""
    return F.when(F.size(lines) > 0, F.aggregate(lines, F.lit(0.0), lambda s, m: s + m["top"] + m["height"] / 2) / F.size(lines))


def text_height(lines: Column) -> Column:
    """The upper median of positive heights of lines, else 0."""
    return F.coalesce(upper_median(F.filter(F.transform(lines, lambda m: m["height"]), lambda h: h > 0)), F.lit(0.0))


def location(y: Column, height: Column) -> Column:
    return F.when(y.isNull(), "UNKNOWN").when(y > BOTTOM * height, "BOTTOM").when(y < TOP * height, "TOP").otherwise("SCENE")


def style(lines: Column, y: Column, height: Column) -> Column:
    """Rows of (style, tags, body), lines in order of box top: bottom and top groups give one, each line of a scene its own."""

    def shown(own: Column) -> Column:
        joined = F.array_join(F.transform(own, lambda m: m["text"]), r"\n")
        spoken = T.language(F.array_join(F.transform(own, lambda m: m["text"]), " "))
        bottom = F.array(F.struct(F.when(spoken == "EN", "Default").otherwise(spoken).alias("style"), F.lit("").alias("tags"), joined.alias("body")))
        top = F.array(F.struct(F.lit("Top").alias("style"), F.lit(r"{\an8}").alias("tags"), joined.alias("body")))
        scene = F.transform(own, lambda m: F.struct(F.lit("Scene").alias("style"), F.format_string(r"{\an5\pos(%d,%d)}", m["x"].cast("int"), m["y"].cast("int")).alias("tags"), m["text"].alias("body")))
        where = location(y, height)
        return F.when(where == "BOTTOM", bottom).when(where == "TOP", top).otherwise(scene)

    return T.let(by_top(lines), shown)


def profiles(groups: DataFrame) -> DataFrame:
    """roi (and video), location (the usual one; MIXED without a clear one), text_height: from (roi, group_id, location, height)."""
    keys = track_of(groups)
    tall = groups.withColumn("tall", F.when(F.col("height") > 0, F.col("height")))
    votes = tall.groupBy(*keys, "location").agg(F.count(F.lit(1)).alias("n"), F.min("group_id").alias("first"), upper_median_of("tall").alias("own"))
    top = votes.groupBy(*keys).agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("first")).alias("f"), "location", "own")).alias("top"))
    every = tall.groupBy(*keys).agg(upper_median_of("tall").alias("every"))
    mixed = (F.col("total") >= 3) & (F.col("top.n") / F.col("total") < SHARE)
    kind = groups.schema["height"].dataType
    height = F.coalesce(F.when(mixed, F.col("every")).otherwise(F.coalesce("top.own", "every")), F.lit(0.0)).cast(kind)
    return top.alias("a").join(every.alias("b"), same_track(keys)).select(*(F.col(f"a.{c}") for c in keys), F.when(mixed, "MIXED").otherwise(F.col("top.location")).alias("location"), height.alias("text_height"))


def drop_outliers(groups: DataFrame) -> DataFrame:
    """Groups that fit their region's profile; all of a region if none does, or if the profile says nothing.

    Beside a profile with a height, a group without one goes.
    """
    keys = track_of(groups)
    p = profiles(groups).select(*keys, F.col("location").alias("usual"), "text_height")
    met = groups.alias("a").join(p.alias("b"), same_track(keys)).select("a.*", "b.usual", "b.text_height")
    fits = F.when(F.col("usual").isin("BOTTOM", "TOP"), F.col("location") != "SCENE").when(F.col("usual") == "SCENE", ~F.col("location").isin("BOTTOM", "TOP")).otherwise(True)
    ratio = (F.col("height") > 0) & (F.col("height") / F.col("text_height")).between(LOW, HIGH)
    keep = F.when(F.col("usual").isin("UNKNOWN", "MIXED") | (F.col("text_height") <= 0), True).otherwise(fits & ratio)
    met = met.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    kept = met.groupBy(*keys).agg(F.max("_keep").alias("_any"))
    return met.alias("a").join(kept.alias("b"), same_track(keys)).where(F.col("_keep") | ~F.col("_any")).select("a.*").drop("_keep", "usual", "text_height")


def end_times(framed: DataFrame, by: list[str], fps: float) -> DataFrame:
    """by, start_sec, end_sec: the last positive time plus the upper median of positive steps between sorted times, else a frame."""
    times = framed.where("time_sec > 0")
    steps = times.withColumn("step", F.col("time_sec") - F.lag("time_sec").over(W.partitionBy(*by).orderBy("time_sec")))
    steps = steps.withColumn("step", F.when(F.col("step") > 0, F.col("step")))
    return steps.groupBy(*by).agg(F.min_by("time_sec", "frame").alias("start_sec"), (F.max("time_sec") + F.coalesce(upper_median_of("step"), F.lit(1.0 / fps if fps > 0 else 0.04))).alias("end_sec"))
