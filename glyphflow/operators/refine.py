"""Edges of visibility, windows to read again, upserts and key comparisons."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphflow.operators.segment import same_track, track_of


def reach(fps: float) -> tuple[int, int]:
    """Frames that are read again before and after an edge."""
    return max(3, int(fps)), max(2, int(fps / 2))


def position_of(roi_id: Column) -> Column:
    """The position of a region in its list, from an id like roi_7; null for other ids."""
    return F.regexp_extract(F.trim(roi_id), r"^roi_(\d+)$", 1).try_cast("int")


def edges(rows: DataFrame, back: int, forward: int) -> DataFrame:
    """roi (and video), frame, lo, hi: frames where ``has`` changes, and the window around each, clipped to the roi's frames."""
    keys = track_of(rows)
    w = W.partitionBy(*keys).orderBy("frame")
    span = rows.groupBy(*keys).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    e = rows.withColumn("was", F.lag("has").over(w)).where(F.col("was").isNotNull() & (F.col("was") != F.col("has")))
    return e.alias("a").join(span.alias("b"), same_track(keys)).select(*(F.col(f"a.{c}") for c in keys), "frame", F.greatest(F.col("frame") - back, "first").alias("lo"), F.least(F.col("frame") + forward, "last").alias("hi"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of ``old``, with the value of ``new`` where it has the key. Keys are unique in ``new``."""
    return old.join(new.withColumnRenamed(value, "_new"), keys, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys that one side lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def refine(results: DataFrame, regions: DataFrame, reader: Callable[[], Callable], fps: float) -> DataFrame:
    """``results`` (roi_id, frame_num, texts) with frames around edges of visibility read again.

    Regions (roi_id, start_frame, end_frame, fade_in_refine_enabled) say which rois are refined and within which
    frames. An edge is a frame that holds text after one that doesn't, or the other way round; around it, from
    ``reach`` frames before (of the last frame with text, if text went) to some after, every frame is read again and
    takes the new texts if there are any. Whether the frame holds text is then judged anew, so edges follow one
    another in order: it is a walk over each roi's frames in one task. ``reader`` makes, once for each task, the
    function (roi_id, frame) -> list of texts, or None where the frame can't be read.
    """
    import pandas as pd

    names = results.columns
    back, forward = reach(fps)
    wanted = regions.where("fade_in_refine_enabled").select("roi_id", F.lit(True).alias("_on"), F.col("start_frame").alias("_lo"), F.col("end_frame").alias("_hi"))
    rows = results.join(wanted, "roi_id", "left").repartition("roi_id").sortWithinPartitions("roi_id", "frame_num")

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        rows = (r for page in pages for r in page.to_dict("records"))
        for _, own in itertools.groupby(rows, key=lambda r: r["roi_id"]):
            done = walked(own, read, back, forward)
            while part := list(itertools.islice(done, 1000)):
                yield pd.DataFrame(part)[names]

    return rows.mapInPandas(run, results.schema)


def _holds(texts) -> bool:
    return texts is not None and any(t and t.strip() for t in texts)


def walked(rows: Iterable[dict], read: Callable, back: int, forward: int) -> Iterator[dict]:
    """``refine`` for the rows of one roi in order; it holds the rows that an edge may still reach back to."""
    held: deque[dict] = deque()
    ahead: dict[int, list] = {}  # texts of frames that haven't come yet
    had, anchor = False, None
    known = lambda x: x is not None and x == x  # noqa: E731  neither null nor NaN
    for now in rows:
        if not known(now["_on"]) or not now["_on"]:
            yield now
            continue
        frame, has = now["frame_num"], _holds(now["texts"])
        if frame in ahead:
            now["texts"] = ahead.pop(frame)
        held.append(now)
        if has != had:
            centre = frame if has else (anchor if anchor is not None else frame - 1)
            first = max(int(now["_lo"]) if known(now["_lo"]) else centre, centre - back)
            last = min(int(now["_hi"]) if known(now["_hi"]) else centre, frame + forward)
            for f in range(first, last + 1):
                new = read(now["roi_id"], f)
                if new is None:
                    continue
                if f > frame:
                    ahead[f] = list(new)
                for r in held:
                    if r["frame_num"] == f:
                        r["texts"] = list(new)
            has = _holds(now["texts"])
        had, anchor = has, frame
        while held and held[0]["frame_num"] < anchor - back:
            yield held.popleft()
    yield from held
