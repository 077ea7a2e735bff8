"""Recognition over a stream of crops, slice by slice of each track, with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphflow.operators import vote
from glyphflow.operators.segment import track_of
from glyphflow.streaming.slices import bucket

ROW = "slice long, frame long, time_sec double, h int, w int, image binary"
KNOWN = f"h int, w int, image binary, lines array<{vote.LINE}>"


class _Slices(StatefulProcessor):
    """State of a track: the rows of its open slice, and the image that was looked at last with the last result."""

    def __init__(self, keys: list[str], made: Callable, shared: bool):
        self.keys, self.made, self.shared, self.own = keys, made, shared, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", ROW)
        self.known = handle.getValueState("known", KNOWN)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        waiting: dict[int, list[dict]] = {}
        for r in self.open.get():
            waiting.setdefault(r[0], []).append(dict(zip(("slice", "frame", "time_sec", "h", "w", "image"), r)))
        ended, last = False, 0
        for page in rows:
            last = max(last, int(page["ts"].max().timestamp() * 1000)) if len(page) else last
            for r in page.to_dict("records"):
                if r["image"] is None:
                    ended = True
                else:
                    waiting.setdefault(r["slice"], []).append(r)
        self.open.clear()
        newest = max(waiting, default=None)
        for at in sorted(waiting):
            if at != newest or ended:
                yield from self._read(key, waiting[at])
            else:
                self.open.put([(r["slice"], r["frame"], r["time_sec"], r["h"], r["w"], bytes(r["image"])) for r in waiting[at]])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if waiting and not ended:
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame([], columns=[*self.keys, "frame", "time_sec", "lines", "calls"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rows = [dict(zip(("slice", "frame", "time_sec", "h", "w", "image"), r)) for r in self.open.get()]
        self.open.clear()
        if rows:
            yield from self._read(key, rows)

    def _read(self, key, rows: list[dict]) -> Iterator:
        import pandas as pd

        self.own = self.own or self.made()
        memory = {}
        if self.shared and self.known.exists():
            h, w, data, lines = self.known.get()
            # lists inside a row of state come back as rows
            memory = {"seen": self.own.decoded(h, w, data), "last": [dict(zip(("text", "score", "box", "polygon"), line)) for line in lines]}
        rows = sorted(rows, key=lambda r: r["frame"])
        out = [(*key, r["frame"], r["time_sec"], lines, calls) for r, lines, calls in self.own.run(iter(rows), memory)]
        if self.shared:
            bgr = memory["seen"]["bgr"]
            self.known.update((*bgr.shape[:2], bgr.tobytes(), [tuple(line[n] for n in ("text", "score", "box", "polygon")) for line in memory["last"]]))
        yield pd.DataFrame(out, columns=[*self.keys, "frame", "time_sec", "lines", "calls"])

    def close(self) -> None:
        pass


def recognised(stream: DataFrame, reader: Callable[[], Callable], slice_sec: float, fps: float = 25.0, late: str = "0 seconds", shared: bool = True, step: int = vote.STEP, moved: float = vote.MOVED, similar: float = vote.ALIKE, delta: int = vote.DELTA, sentinel: bool = True) -> DataFrame:
    """What ``vote.skip_runs`` gives for the same slices, of a stream (roi; video too, where there is one; frame, time_sec,
    h, w, image, and ts, a timestamp to close the last slices by), in however many micro-batches the frames come.

    A slice is read when a row of a later slice of its track comes, when a row without image says that the track ends, or
    when the watermark of ts (``late``) passes its last row. With ``shared``, a slice knows the last image and result of
    the one before it; else it begins afresh. Rows of a micro-batch may come in any order, but a row of a slice that has
    been read already is a slice of its own. State is a slice of images for each track, and outlives a restart from the
    checkpoint. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    keys = track_of(stream)
    made = lambda: vote.Recogniser(reader, step, moved, similar, delta, sentinel)
    rows = stream.select(*(F.col(k).cast("string").alias(k) for k in keys), bucket(F.col("time_sec"), F.col("frame"), fps, slice_sec).alias("slice"), F.col("frame").cast("long").alias("frame"), F.col("time_sec").cast("double").alias("time_sec"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "image", "ts").withWatermark("ts", late)
    schema = ", ".join(f"{k} string" for k in keys) + f", frame long, time_sec double, lines array<{vote.LINE}>, calls int"
    return rows.groupBy(*keys).transformWithStateInPandas(_Slices(keys, made, shared), schema, "Append", "EventTime")
