"""Subtitle times: formats and parsing on double seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clock(whole: Column, hundredths: Column) -> Column:
    return F.format_string("%d:%02d:%02d.%02d", F.floor(whole / 3600).cast("long"), F.floor((whole % 3600) / 60).cast("long"), (whole % 60).cast("long"), hundredths.cast("long"))


def from_frame(frame: Column, fps: Column | float) -> Column:
    """H:MM:SS.cc with hundredths cut off."""
    s = frame / (fps if isinstance(fps, Column) else F.lit(fps))
    return _clock(F.floor(s), F.floor((s - F.floor(s)) * 100))


def from_seconds(sec: Column) -> Column:
    """H:MM:SS.cc; negative is 0; hundredths round half to even, and 100 stays 99."""
    s = F.greatest(sec, F.lit(0.0))
    return _clock(F.floor(s), F.least(F.rint((s - F.floor(s)) * 100), F.lit(99.0)))


def to_seconds(text: Column) -> Column:
    """Seconds of H:MM:SS.cc, null unless it has three parts of numbers."""
    p = F.split(F.trim(text), ":", -1)
    at = lambda i, kind: F.get(p, F.lit(i)).try_cast(kind)
    return F.when(F.size(p) == 3, at(0, "int") * 3600.0 + at(1, "int") * 60.0 + at(2, "double"))


def roi_seconds(text: Column) -> Column:
    """Seconds of H:M:S[.,]f, where f counts milliseconds as an integer."""
    p = F.split(F.regexp_replace(text, ",", "."), "[:.]", -1)
    n = lambda i: F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(0))
    return n(0) * 3600.0 + n(1) * 60.0 + n(2) + n(3) / 1000.0


def frame_number(frame: Column, time: Column, fps: Column | float) -> Column:
    """A bound of a region: the explicit frame, else that of a time text of three parts, else of a number of seconds.

    Frames of times are cut towards zero. A text of any other shape has no frame (null).
    """
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    spoken = F.when(F.size(F.split(time, ":", -1)) == 3, roi_seconds(time)).otherwise(time.try_cast("double"))
    return F.coalesce(frame.cast("long"), (spoken * rate).cast("long"))


def clock(sec: Column) -> Column:
    """HH:MM:SS.mmm with milliseconds cut off; negative is 0."""
    s = F.greatest(sec, F.lit(0.0))
    whole = F.floor(s)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600).cast("long"), F.floor((whole % 3600) / 60).cast("long"), (whole % 60).cast("long"), F.floor((s - whole) * 1000).cast("long"))


def from_clock(text: Column) -> Column:
    """Seconds of H:M:S[.,]f, M:S[.,]f or a number; f counts milliseconds as an integer. Null where a part isn't a number."""
    p = F.split(F.regexp_replace(text, ",", "."), ":", -1)
    last = F.split(F.get(p, F.size(p) - 1), r"\.", -1)
    sec = F.get(last, F.lit(0)).try_cast("int") + F.when(F.size(last) > 1, F.get(last, F.lit(1)).try_cast("int")).otherwise(0) / 1000.0
    at = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, at(0) * 3600 + at(1) * 60 + sec).when(F.size(p) == 2, at(0) * 60 + sec).otherwise(text.try_cast("double"))


def duration(start: Column, end: Column) -> Column:
    """Seconds between two formatted times; 0 where one can't be read."""
    return F.coalesce(to_seconds(end) - to_seconds(start), F.lit(0.0))
