"""Time slices of tracks: batch buckets, and the same as a stream with state for each roi."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def bucket(time_sec: Column, frame: Column, fps: float, width: float) -> Column:
    """Number of the slice; time falls back to the frame's, and what isn't after 0 is in slice 0."""
    t = F.when(time_sec > 0, time_sec).otherwise(frame / F.lit(fps if fps > 0 else 1.0))
    return F.when(t > 0, F.floor(t / width)).otherwise(0).cast("long")


def slices(rows: DataFrame, width: float, fps: float = 25.0) -> DataFrame:
    """roi, slice, n, first_frame, last_frame."""
    b = bucket(F.col("time_sec"), F.col("frame"), fps, width).alias("slice")
    return rows.groupBy("roi", b).agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def tumbling(stream: DataFrame, width: str = "10 seconds", late: str = "30 seconds", time_col: str = "ts", key: str = "user_id") -> DataFrame:
    """Counts by key and window of event time, closed by the watermark."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


class _Counts(StatefulProcessor):
    """State of a track: slice, n, first and last frame of its open slice."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "slice long, n long, first long, last long")

    def _rows(self, key, slices_: list[tuple]):
        return pd.DataFrame([(*key, *s) for s in slices_], columns=[*self.keys, "slice", "n", "first_frame", "last_frame"])

    def handleInputRows(self, key, rows, timerValues):
        found: dict[int, list[int]] = {}  # of this micro-batch: a few slices, however many rows
        ended, late = False, 0
        for page in rows:
            ended |= bool(page["frame"].isna().any())
            late = max(late, int(page["ts"].max().timestamp() * 1000))
            page = page[page["frame"].notna()]
            for at, own in page.groupby("slice")["frame"].agg(["size", "min", "max"]).iterrows():
                n, lo, hi = found.get(at, (0, own["min"], own["max"]))
                found[at] = (n + int(own["size"]), int(min(lo, own["min"])), int(max(hi, own["max"])))
        held, out = self.open.get() if self.open.exists() else None, []
        for at in sorted(found):
            n, lo, hi = found[at]
            if held is not None and held[0] == at:
                held = (at, held[1] + n, min(held[2], lo), max(held[3], hi))
            else:
                out += [held] if held is not None else []
                held = (at, n, lo, hi)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held is not None and ended:
            out.append(held)
            held = None
        if held is None:
            self.open.clear()
        else:
            self.open.update(tuple(int(v) for v in held))
            self.handle.registerTimer(max(late, timerValues.getCurrentWatermarkInMs()) + 1)
        yield self._rows(key, [tuple(map(int, s)) for s in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.open.get() if self.open.exists() else None
        self.open.clear()
        yield self._rows(key, [tuple(held)] if held is not None else [])

    def close(self) -> None:
        pass


def flushed(stream: DataFrame, width: float, fps: float = 25.0, late: str = "0 seconds") -> DataFrame:
    """roi (and video), slice, n, first_frame, last_frame: of a stream (roi, frame, time_sec, and ts to close the last slices
    by).

    The open slice of a track is a row of state; when a row of another slice comes it goes out. The last one goes out when a
    row without frame says that the track ends, or when the watermark of ts passes its last row. Rows of a micro-batch
    count by slice, in any order. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    from glyphflow.operators.segment import track_of

    keys = track_of(stream)
    timed = stream.withColumn("slice", bucket(F.col("time_sec"), F.col("frame"), fps, width)).select(*keys, F.col("frame").cast("long").alias("frame"), "slice", "ts").withWatermark("ts", late)
    schema = ", ".join(f"{k} {dict(stream.dtypes)[k]}" for k in keys) + ", slice long, n long, first_frame long, last_frame long"
    return timed.groupBy(*keys).transformWithStateInPandas(_Counts(keys), schema, "Append", "EventTime")


def ended(query, stop) -> bool:
    """Waits for a streaming query, and stops it as soon as ``stop()`` holds; whether it came to its own end."""
    while not query.awaitTermination(0.2):
        if stop():
            query.stop()
            return False
    return True


def last_known(stream: DataFrame, key: str = "user_id", value: str = "event_type") -> DataFrame:
    """key, n, last: rows seen and the last value of each key, kept as state between micro-batches."""
    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last, at = state.get if state.exists else (0, None, -1)
        for b in batches:
            n += len(b)
            top = b.loc[b["event_id"].idxmax()]
            if int(top["event_id"]) > at:
                last, at = top[value], int(top["event_id"])
        state.update((n, last, at))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last": [last]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, last string", "n long, last string, at long", "update", "NoTimeout")
