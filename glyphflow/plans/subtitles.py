"""The main query: recognised lines to subtitle events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.functions import timefmt
from glyphflow.operators import classify, merge, profile, segment
from glyphflow.operators.staging import staged
from glyphflow.sources import writers


def filtered(lines: DataFrame, preset: str, width: int, height: int) -> DataFrame:
    """Lines whose source the preset keeps: overlay, scene or unknown, by place and words.

    Without x1 and x2, the sides of its box, a line counts as a point across.
    """
    side = lambda c: F.col(c) if c in lines.columns else F.col("x")
    top = F.col("top") if "top" in lines.columns else F.col("y")
    tall = F.col("height") if "height" in lines.columns else F.lit(0.0)
    f = classify.spatial_features(F.array(*[c.cast("double") for c in (side("x1"), top, side("x2"), top + tall)]), F.lit(width), F.lit(height))
    placed = lines.withColumns({k: f[k] for k in ("rel_y", "rel_height", "edge")})
    return classify.keep(classify.classify(placed, preset), preset).select(lines.columns)


def raw_events(lines: DataFrame, height: int = 100, fps: float = 25.0) -> DataFrame:
    """roi (and video), seq, start_sec, end_sec, start_time, end_time, style, tags, body: before noise goes and neighbours merge.

    Groups that don't fit the profile of their roi are left out. A group without any positive time is timed by its
    frames, whose hundredths are cut off; others by seconds, whose hundredths are rounded.
    """
    groups = segment.groups(segment.frames(segment.readable(lines)))
    y = profile.centre_y(F.col("lines"))
    placed = groups.withColumns({"group_id": F.col("start_frame"), "y": y, "location": profile.location(y, F.lit(height)), "height": profile.text_height(F.col("lines"))})
    kept = profile.drop_outliers(staged(placed, "groups"))  # which reads them several times
    spoken = F.col("start_sec").isNotNull()
    end = F.when(spoken, F.col("last_sec") + F.coalesce("step", F.lit(1.0 / fps if fps > 0 else 0.04))).otherwise((F.col("end_frame") + 1) / fps)
    start = F.when(spoken, F.col("start_sec")).otherwise(F.col("start_frame") / fps)
    text = lambda sec, frame: F.when(spoken, timefmt.from_seconds(sec)).otherwise(timefmt.from_frame(frame, fps))
    keys = segment.track_of(lines)
    rows = kept.select(*keys, "start_frame", start.alias("start_sec"), end.alias("end_sec"), text(start, F.col("start_frame")).alias("start_time"), text(end, F.col("end_frame") + 1).alias("end_time"), F.posexplode(profile.style(F.col("lines"), F.col("y"), F.lit(height))).alias("k", "e"))
    return rows.select(*keys, (F.col("start_frame") * 1000 + F.col("k")).alias("seq"), "start_sec", "end_sec", "start_time", "end_time", "e.style", "e.tags", "e.body")


def events(lines: DataFrame, height: int = 100, fps: float = 25.0, preset: str | None = None, width: int = 100) -> DataFrame:
    """roi, seq, start_sec, end_sec, start_time, end_time, style, tags, body: from lines (roi, seq, frame, time_sec, text,
    score, x, y; top, height; video, where there are several, whose tracks are kept apart). With ``preset``, only of lines whose source it keeps."""
    if preset is not None:
        lines = filtered(segment.readable(lines), preset, width, height)
    return merge.merge_neighbours(merge.drop_noise(raw_events(lines, height, fps))).withColumnRenamed("island", "seq").drop("n")


def dialogue(lines: DataFrame, height: int = 100, fps: float = 25.0) -> DataFrame:
    """roi, seq, start, line: the lines of a subtitle file."""
    return writers.event_lines(events(lines, height, fps))
