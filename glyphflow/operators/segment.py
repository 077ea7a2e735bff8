"""From observations to groups: filter, gather lines by frame, cut a track where it stops resembling its anchor."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.functions import text as T
from glyphflow.operators import fold

MIN_SCORE, MIN_FRAMES = 0.6, 3
BRIDGE_FRAMES, BRIDGE_SEC, SIMILAR, NEAR_PX = 8, 0.45, 0.85, 20.0
#: A line within its frame; x and y are its centre, top and height those of its box.
LINE = "struct<seq:long,text:string,x:double,y:double,top:double,height:double>"


def track_of(rows: DataFrame) -> list[str]:
    """The columns that tell tracks apart: roi, and video where there is one, since every video has a roi_0."""
    return [c for c in ("video", "roi") if c in rows.columns]


def same_track(keys: list[str]) -> Column:
    """The condition of a join of ``a`` and ``b`` by such columns, nulls being equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def readable(lines: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Lines sure enough and not blank (no character but Unicode white space)."""
    return lines.where((F.col("score") >= least) & ~T.is_blank(F.col("text")))


def frames(lines: DataFrame) -> DataFrame:
    """roi (and video), frame, time_sec (first positive in order of seq, else 0), lines (``LINE``, by seq).

    From (roi, seq, frame, time_sec, text, x, y) and, where there are, top and height of the line's box.
    """
    first = F.min(F.when(F.col("time_sec") > 0, F.struct("seq", "time_sec")))
    top = F.col("top") if "top" in lines.columns else F.col("y")
    height = F.col("height") if "height" in lines.columns else F.lit(0.0)
    line = F.struct("seq", "text", F.col("x").alias("x"), F.col("y").alias("y"), top.alias("top"), height.alias("height")).cast(LINE)
    return lines.groupBy(*track_of(lines), "frame").agg(F.coalesce(first["time_sec"], F.lit(0.0)).alias("time_sec"), F.sort_array(F.collect_list(line)).alias("lines"))


def by_top(lines: Column) -> Column:
    """Lines in order of box top, equal ones by seq."""
    keyed = F.transform(lines, lambda m: F.struct(m["top"].alias("t"), m["seq"].alias("s"), m.alias("m")))
    return F.transform(F.sort_array(keyed), lambda k: k["m"])


def texts_equal(a: Column, b: Column) -> Column:
    """Concatenated texts of two recognitions are equal, and there is some."""
    joined = lambda c: T.strip(F.array_join(c, ""))
    return (joined(a) != "") & (joined(a) == joined(b))


def text_present(texts: Column) -> Column:
    return F.coalesce(F.exists(texts, lambda t: ~T.is_blank(t)), F.lit(False))


def _alike(a: str, b: str) -> bool:
    """Both hold text, and twice the common subsequence is enough of the total length."""
    if not a or not b or 2 * min(len(a), len(b)) < SIMILAR * (len(a) + len(b)):
        return False
    if 2 * sum(map(operator.eq, a, b)) / (len(a) + len(b)) >= SIMILAR:  # what agrees place by place is a common subsequence
        return True
    return 2 * T.subsequence(a, b, int(SIMILAR * (len(a) + len(b)) / 2)) / (len(a) + len(b)) >= SIMILAR


def _near(a: dict, b: dict) -> bool:
    for p, q, r, s in zip(a["x"], b["x"], a["y"], b["y"]):
        if not (p - q) ** 2 + (r - s) ** 2 <= NEAR_PX**2:
            return False
    return True


def _sorted(texts: list) -> list:
    return sorted(texts, key=lambda t: (t is None, t or "")) if None in texts else sorted(texts)


def _bare(texts: list) -> str:
    return "".join([t for t in texts if t is not None] if None in texts else texts).replace(" ", "")


def _goes_on(anchor: dict, last: dict, now: dict) -> bool:
    """``texts``, ``x`` and ``y`` are those of the lines of a frame, in order of box top."""
    gap, own, texts = now["frame"] - last["frame"], anchor["texts"], now["texts"]
    if not 1 <= gap <= BRIDGE_FRAMES or len(own) != len(texts):
        return False
    same = own == texts or _sorted(own) == _sorted(texts)
    if gap == 1:
        return _near(anchor, now) if same else _alike(_bare(_sorted(own)), _bare(_sorted(texts)))
    x, y, dt = _bare(own), _bare(texts), now["time_sec"] - last["time_sec"]
    if not x or len(x) != len(y) or (last["time_sec"] > 0 and now["time_sec"] > 0 and dt > BRIDGE_SEC):
        return False
    return (same or _alike(x, y)) and _near(anchor, now)


def marked(framed: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of ``framed`` (roi, frame, time_sec, lines; video too, where there is one) with run, the frame that each one's
    run begins with.

    A run goes on while frames resemble its first one: a fold in order of frames, over as many tasks as a track fills
    (``fold.runs``). Frames without lines take no part. Lines come back in order of box top.
    """
    keys = track_of(framed)
    rows = framed.where(F.size("lines") > 0).select(*keys, F.col("frame").cast("long").alias("frame"), "time_sec", by_top(F.col("lines")).alias("lines"))
    seen = {"texts": F.col("lines.text"), "x": F.col("lines.x"), "y": F.col("lines.y")}
    return fold.runs(rows, keys, ["frame"], "frame", ["time_sec"], _goes_on, parts=parts, seen=seen)


def groups(framed: DataFrame, min_frames: int = MIN_FRAMES) -> DataFrame:
    """roi, start_frame, end_frame, n_frames, start_sec, last_sec, step, lines: runs that last ``min_frames`` frames.

    lines are those of the first frame; start_sec is the first positive time, last_sec the greatest, step the upper
    median of the positive distances of sorted times (null without any).
    """
    from pyspark.sql import Window as W

    from glyphflow.operators.merge import upper_median_of

    keys, timed = track_of(framed), marked(framed).withColumn("t", F.when(F.col("time_sec") > 0, F.col("time_sec")))
    # rows without a time come last, so none stands between two others; runs are dealt once, with the lines of one frame
    step = F.col("t") - F.lag("t").over(W.partitionBy(*keys, "run").orderBy(F.col("t").asc_nulls_last()))
    timed = timed.withColumn("lines", F.when(F.col("frame") == F.col("run"), F.col("lines")))
    g = timed.withColumn("step", F.when(step > 0, step)).groupBy(*keys, F.col("run").alias("start_frame")).agg(
        F.max("frame").alias("end_frame"),
        F.count(F.lit(1)).alias("n_frames"),
        F.min(F.when(F.col("t").isNotNull(), F.struct("frame", "t")))["t"].alias("start_sec"),
        F.max("t").alias("last_sec"),
        upper_median_of("step").alias("step"),
        F.min_by("lines", "frame").alias("lines"),
    )
    return g.where(F.col("end_frame") - F.col("start_frame") + 1 >= min_frames).select(*keys, "start_frame", "end_frame", "n_frames", "start_sec", "last_sec", "step", "lines")


def segments(framed: DataFrame, min_frames: int = MIN_FRAMES) -> DataFrame:
    """roi, group_id (from 0 in order of frames), start_frame, end_frame, n_frames."""
    from pyspark.sql import Window as W

    keys, g = track_of(framed), groups(framed, min_frames)
    return g.select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy("start_frame")) - 1).cast("long").alias("group_id"), "start_frame", "end_frame", "n_frames")
