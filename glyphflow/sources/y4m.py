"""Frames of uncompressed videos (YUV4MPEG2), read by ranges of bytes: any frame is found without those before it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from glyphflow.sources.files import place

FRAME = "video_id string, frame long, time_sec double, h int, w int, image binary"
#: Fixed values of the file format.
MAGIC, MARK = b"YUV4MPEG2", b"FRAME\n"
#: How far the colour planes of a layout are narrower and lower.
LAYOUTS = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}


@dataclass(frozen=True)
class Video:
    w: int
    h: int
    fps: float
    layout: str
    first: int  # where the first frame begins
    total: int  # whole frames

    @property
    def plane(self) -> tuple[int, int]:
        down = LAYOUTS[self.layout]
        return (0, 0) if down is None else (-(-self.h // down[1]), -(-self.w // down[0]))

    @property
    def size(self) -> int:
        return self.w * self.h + 2 * self.plane[0] * self.plane[1]


def opened(path: str):
    system, at = place(path)
    return system.open_input_file(at)


def described(f) -> Video:
    """What the header of an open file says; an error if it isn't such a file."""
    head = f.read_at(256, 0) if f.size() >= 256 else f.read_at(f.size(), 0)
    line, end, _ = head.partition(b"\n")
    fields = {x[:1]: x[1:] for x in line.decode("ascii", "replace").split()[1:]}
    rate = re.fullmatch(r"(\d+):(\d+)", fields.get("F", ""))
    layout = fields.get("C", "420")
    if not line.startswith(MAGIC) or not end or layout not in LAYOUTS or not fields.get("W", "").isdigit() or not fields.get("H", "").isdigit():
        raise ValueError(f"not a YUV4MPEG2 file of a known layout: {line[:80]!r}")
    fps = int(rate[1]) / int(rate[2]) if rate and int(rate[2]) else 0.0
    v = Video(int(fields["W"]), int(fields["H"]), fps, layout, len(line) + 1, 0)
    return Video(v.w, v.h, v.fps, v.layout, v.first, max(0, f.size() - v.first) // (len(MARK) + v.size))


def decoded(video: Video, data: bytes):
    """BGR pixels (h x w x 3) of a frame's planes: full range for jpeg, else video range; without colour all three are the light."""
    import numpy as np

    raw = np.frombuffer(data, np.uint8)
    y = raw[: video.w * video.h].reshape(video.h, video.w).astype(np.float32)
    down = LAYOUTS[video.layout]
    if down is None:
        return np.repeat(y.astype(np.uint8)[..., None], 3, axis=2)
    ph, pw = video.plane
    u, v = (np.repeat(np.repeat(p.reshape(ph, pw), down[1], 0), down[0], 1)[: video.h, : video.w].astype(np.float32) - 128 for p in np.split(raw[video.w * video.h :], 2))
    full = video.layout == "420jpeg"
    light, gain = (y, 1.0) if full else ((y - 16) * np.float32(255 / 219), np.float32(255 / 224))
    bgr = np.stack([light + 1.772 * gain * u, light - gain * (0.344136 * u + 0.714136 * v), light + 1.402 * gain * v], axis=2)
    return np.clip(np.rint(bgr), 0, 255).astype(np.uint8)


def read(path: str, frames: list[int]) -> Iterator[tuple[int, float, object]]:
    """(frame, seconds, BGR pixels) of the frames asked for that the file has; nothing else is read."""
    with opened(path) as f:
        video = described(f)
        step = len(MARK) + video.size
        for n in frames:
            if 0 <= n < video.total:
                data = f.read_at(step, video.first + n * step)
                if not data.startswith(MARK):
                    raise ValueError(f"{path}: frame {n} isn't where it should be")
                yield n, n / video.fps if video.fps > 0 else 0.0, decoded(video, data[len(MARK) :])


def batches(video_id: str, found: Iterator[tuple[int, float, object]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of ``FRAME``, some megabytes of pixels at a time."""
    rows, held = [], 0

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows))
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in FRAME.split(", ")])

    for n, sec, bgr in found:
        rows.append((video_id, n, sec, bgr.shape[0], bgr.shape[1], bgr.tobytes()))
        held += bgr.nbytes
        if held >= most:
            yield out()
            rows, held = [], 0
    if rows:
        yield out()


@dataclass
class _Range(InputPartition):
    video_id: str
    path: str
    first: int
    last: int

    def __init__(self, video_id: str, path: str, first: int, last: int):
        self.video_id, self.path, self.first, self.last = video_id, path, first, last


class Y4M(DataSource):
    """``spark.read.format("glyphflow_y4m").load(file or folder)``: rows of ``FRAME`` of all .y4m files there, in partitions of
    ``range`` frames (option, 250). With option ``push``, conditions on video_id (a file's name without its ending) and frame
    leave out files and frames before anything is read; Spark wants ``spark.sql.python.filterPushdown.enabled`` for that."""

    @classmethod
    def name(cls) -> str:
        return "glyphflow_y4m"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        kind = _Pushed if str(self.options.get("push", "")).lower() == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("range", 250)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step, self.names, self.lo, self.hi, self.own = path, max(1, step), None, 0, None, None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = place(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        out = []
        for x in sorted(found, key=lambda x: x.path):
            name = x.base_name.removesuffix(".y4m")
            if x.type != fs.FileType.File or not x.base_name.endswith(".y4m") or self.names is not None and name not in self.names:
                continue
            with opened(scheme + x.path) as f:
                last = described(f).total - 1
            lo, hi = self.lo, last if self.hi is None else min(last, self.hi)
            if self.own is not None:
                lo, hi = max(lo, min(self.own, default=hi + 1)), min(hi, max(self.own, default=-1))
            out += [_Range(name, scheme + x.path, a, min(a + self.step - 1, hi)) for a in range(lo, hi + 1, self.step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Range):  # no partitions at all
            return
        wanted = [n for n in range(partition.first, partition.last + 1) if self.own is None or n in self.own]
        yield from batches(partition.video_id, read(partition.path, wanted))


class _Pushed(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("video_id",) and isinstance(f, (EqualTo, In)):
                own = {value} if isinstance(f, EqualTo) else set(value)
                self.names = own if self.names is None else self.names & own
            elif column == ("frame",) and isinstance(f, (EqualTo, In)):
                own = {value} if isinstance(f, EqualTo) else {v for v in value if v is not None}
                self.own = own if self.own is None else self.own & own
            elif column == ("frame",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.lo = max(self.lo, value + isinstance(f, GreaterThan))
            elif column == ("frame",) and isinstance(f, (LessThan, LessThanOrEqual)):
                hi = value - isinstance(f, LessThan)
                self.hi = hi if self.hi is None else min(self.hi, hi)
            else:
                yield f
