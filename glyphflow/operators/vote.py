"""Positional votes over samples of a run, reuse of the last result, and the run-length skip with an injected reader."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STEP, MOVED, ALIKE, DELTA = 15, 0.05, 0.98, 10
STACK = 1 << 18  # pixels of the images that are compared at once
LINE = "struct<text:string,score:double,box:array<double>,polygon:array<array<double>>>"


def samples(frames: DataFrame, by: list[str]) -> DataFrame:
    """The first, middle (of three or more) and last frame of each run, with sample, their order in it."""
    w = W.partitionBy(*by).orderBy("frame")
    placed = frames.withColumns({"_at": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*by))})
    wanted = (F.col("_at") == 0) | (F.col("_at") == F.col("_n") - 1) | ((F.col("_n") > 2) & (F.col("_at") == F.floor(F.col("_n") / 2)))
    return placed.where(wanted).withColumn("sample", F.col("_at")).drop("_at", "_n")


def positional_vote(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, line_idx, text, score and, where there are, box and polygon: from (by, sample, line_idx, text, score), samples in order.

    For each line of the first sample, the text with most votes, then the best mean score, then the one seen first;
    the rest is that of the first sample that holds it.
    """
    own = [c for c in ("score", "box", "polygon") if c in lines.columns]
    first = lines.groupBy(*by).agg(F.min("sample").alias("_first"))
    wanted = lines.join(first, by).where("sample = _first").select(*by, "line_idx")
    votes = lines.join(wanted, [*by, "line_idx"], "left_semi").groupBy(*by, "line_idx", "text").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.min("sample").alias("at"), F.min_by(F.struct(*own), "sample").alias("own"))
    return votes.groupBy(*by, "line_idx").agg(F.max(F.struct("n", "mean", (-F.col("at")).alias("at"), "text", "own")).alias("m")).select(*by, "line_idx", "m.text", *[f"m.own.{c}" for c in own])


def fill_forward(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``value`` is what was last known."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def _text(read: list[dict]) -> str:
    return "".join(r["text"] for r in read).strip()


def _voted(reads: list[list[dict]]) -> list[dict]:
    """For each line of the first reading, the text most readings have there, then of best mean score, then seen first."""
    out = []
    for k in range(len(reads[0])):
        seen: dict[str, list[dict]] = {}
        for r in reads:
            if k < len(r):
                seen.setdefault(r[k]["text"], []).append(r[k])
        out.append(max(seen.values(), key=lambda own: (len(own), sum(x["score"] for x in own) / len(own)))[0])
    return out


class _Track:
    """The images of a roi as they come, as far back as something still asks for them."""

    def __init__(self, rows: Iterator[dict]):
        self.rows, self.held, self.first, self.ended = rows, [], 0, False

    def has(self, at: int) -> bool:
        while not self.ended and at >= self.first + len(self.held):
            row = next(self.rows, None)
            self.ended = row is None
            if row is not None:
                self.held.append(row)
        return at < self.first + len(self.held)

    def __getitem__(self, at: int) -> dict:
        return self.held[at - self.first]

    def forget(self, before: int) -> None:
        self.held = self.held[before - self.first :]
        self.first = before


def read_runs(rows: Iterator[dict], read: Callable, alike: Callable, moved: Callable, step: int = STEP, memory: dict | None = None) -> Iterator[tuple[dict, list[dict], int]]:
    """(row, its lines, calls of ``read`` it took) for the rows of one roi in order of frames; row["image"] is an image.

    An image that hardly moved since the last one that was looked at takes the last result. Else it is read; if it
    holds text, images are probed at growing distance until one isn't alike, the end of the run is found by halving
    (alike, and the same text), and the run takes the vote of its first, middle and last image. Images are held from
    the start of a run to its last probe. ``memory`` holds the image that was looked at last (seen) and the last result
    (last), from rows before these and, at the end, for those after them.
    """
    memory = {} if memory is None else memory
    track, at, last = _Track(rows), 0, memory.get("last", [])
    while track.has(at):
        now, seen = track[at], memory.get("seen")
        still = seen is not None and not moved(seen, now["image"])
        memory["seen"], memory["last"] = now["image"], last
        if still:
            yield now, last, 0
            at += 1
            track.forget(at)
            continue
        own = last = memory["last"] = read(now["image"])
        calls = 1
        if not _text(own):
            yield now, own, calls
            at += 1
            track.forget(at)
            continue
        end, probe = at, at + 1
        while track.has(probe) and alike(now["image"], track[probe]["image"]):
            probe += step
        lo, hi = at + 1, probe if track.has(probe) else track.first + len(track.held) - 1
        while lo <= hi:
            mid = (lo + hi) // 2
            same = alike(now["image"], track[mid]["image"])
            if same:
                calls += 1
                same = _text(read(track[mid]["image"])) == _text(own)
            lo, hi = (mid + 1, hi) if same else (lo, mid - 1)
            end = mid if same else end
        n = end - at + 1
        picked = sorted({0, n // 2 if n > 2 else 0, n - 1})
        reads = [own, *(read(track[at + k]["image"]) for k in picked[1:])]
        calls += len(picked) - 1
        last = memory["last"] = _voted(reads) if len(reads) > 1 else reads[0]
        for k in range(at, end + 1):
            yield track[k], last, calls if k == at else 0
        at = end + 1
        track.forget(at)


class Recogniser:
    """``read_runs`` over rows (.., h, w, image: BGR bytes) as a task does it: made there, with the task's reader."""

    def __init__(self, reader: Callable[[], Callable], step: int, moved: float, similar: float, delta: int, sentinel: bool):
        from glyphflow.operators import image

        read_raw, self.step, self.image = reader(), step, image
        self.read = lambda x: [dict(zip(("text", "score", "box", "polygon"), line)) for line in read_raw(x["bgr"])]
        self.alike = lambda a, b: image.structural_similarity(a["gray"], b["gray"]) >= similar
        self.moved = (lambda a, b: image.changed_share(a["gray"], b["gray"], delta) >= moved) if sentinel else (lambda a, b: True)

    def decoded(self, h: int, w: int, data: bytes) -> dict:
        bgr = self.image.decode(data, h, w)
        return {"bgr": bgr, "gray": self.image.gray(bgr)}

    def run(self, rows: Iterator[dict], memory: dict) -> Iterator[tuple[dict, list[dict], int]]:
        decoded = (r | {"image": self.decoded(r["h"], r["w"], r["image"])} for r in rows)
        return read_runs(decoded, self.read, self.alike, self.moved, self.step, memory)


def skip_runs(crops: DataFrame, reader: Callable[[], Callable], step: int = STEP, moved: float = MOVED, similar: float = ALIKE, delta: int = DELTA, sentinel: bool = True, slice_sec: float | None = None, fps: float = 25.0, shared: bool = False) -> DataFrame:
    """roi (and video), frame, time_sec, lines (``LINE``), calls: recognition of crops (roi, frame, time_sec, h, w, image)
    by runs.

    ``reader`` makes, once for each task, the function that recognises an image (h x w x 3, BGR): a list of (text,
    score, box, polygon). With ``slice_sec``, a track is cut into slices of time (``slices.bucket``), which runs don't
    cross. Then each slice begins afresh and is a task's of its own, so that a long track takes many; unless slices are
    ``shared``: one after the other in one task, each knowing the last image and result of the one before. A task holds
    the images of one run at a time.
    """
    import itertools

    from glyphflow.operators.segment import track_of
    from glyphflow.streaming.slices import bucket

    keys = track_of(crops)
    names = [*keys, "frame", "time_sec", "lines", "calls"]

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, track, memory = Recogniser(reader, step, moved, similar, delta, sentinel), None, {}
        rows = (r for page in pages for r in page.to_dict("records"))
        for (now, _), part in itertools.groupby(rows, key=lambda r: (tuple(r[k] for k in keys), r["_slice"])):
            memory = memory if shared and now == track else {}
            track = now
            done = ((*now, r["frame"], r["time_sec"], lines, calls) for r, lines, calls in own.run(part, memory))
            while out := list(itertools.islice(done, 500)):
                yield pd.DataFrame(out, columns=names)

    part = bucket(F.col("time_sec"), F.col("frame"), fps, slice_sec) if slice_sec else F.lit(0).cast("long")
    rows = crops.select(*(F.col(k).cast("string") for k in keys), F.col("frame").cast("long"), F.col("time_sec").cast("double"), F.col("h").cast("int"), F.col("w").cast("int"), "image").withColumn("_slice", part)
    dealt = rows.repartition(*keys, *([] if shared or not slice_sec else ["_slice"]))
    schema = ", ".join(f"{k} string" for k in keys) + f", frame long, time_sec double, lines array<{LINE}>, calls int"
    return dealt.sortWithinPartitions(*keys, "_slice", "frame").mapInPandas(run, schema)


def changes(crops: DataFrame, delta: int = DELTA) -> DataFrame:
    """roi (and video), frame, changed, similarity: of each crop against the one before it in its track: the share of pixels
    that differ by more than ``delta`` (1 if the size changed), and the structural similarity (0 if it did). Null for the
    first crop of a track.
    """
    from glyphflow.operators import image
    from glyphflow.operators.segment import track_of

    def compared(kernel: Callable, other: float):
        """``kernel`` over stacks of pairs of one shape, ``other`` where the shape changed. What isn't selected isn't computed."""

        @F.pandas_udf("double")
        def run(h: pd.Series, w: pd.Series, data: pd.Series, ph: pd.Series, pw: pd.Series, before: pd.Series) -> pd.Series:
            import numpy as np

            out = np.full(len(data), np.nan)
            met = before.notna().to_numpy()
            same = met & (h == ph).to_numpy() & (w == pw).to_numpy()
            out[met & ~same] = other
            for (y, x), at in pd.Series(np.flatnonzero(same)).groupby([h.to_numpy()[same], w.to_numpy()[same]]):
                step = max(1, STACK // max(1, int(y) * int(x)))
                for k in range(0, len(at), step):
                    own = at.iloc[k : k + step].to_numpy()
                    now, was = (image.gray(np.stack([image.decode(b, int(y), int(x)) for b in c.iloc[own]])) for c in (data, before))
                    out[own] = kernel(was, now)
            return pd.Series(out)  # NaN is null

        return run

    keys, shown = track_of(crops), ("h", "w", "image", "_h", "_w", "_image")
    w = W.partitionBy(*keys).orderBy("frame")
    met = crops.select(*keys, "frame", "h", "w", "image", *(F.lag(c).over(w).alias(f"_{c}") for c in ("h", "w", "image")))
    share = compared(lambda a, b: image.changed_shares(a, b, delta), 1.0)
    return met.select(*keys, "frame", share(*shown).alias("changed"), compared(image.structural_similarities, 0.0)(*shown).alias("similarity"))


def run_metrics(results: DataFrame) -> DataFrame:
    """roi (and video), frames, calls, filled (frames that took the reading of another), saved: what skipping runs was worth."""
    from glyphflow.operators.segment import track_of

    m = results.groupBy(*track_of(results)).agg(F.count(F.lit(1)).alias("frames"), F.sum("calls").alias("calls"), F.count_if(F.col("calls") == 0).alias("filled"))
    return m.withColumn("saved", 1 - F.least(F.col("calls") / F.col("frames"), F.lit(1.0)))


def observed(results: DataFrame, observation) -> DataFrame:
    """``results`` with rows and calls counted on the way, for an ``Observation`` that whoever writes them reads."""
    return results.observe(observation, F.count(F.lit(1)).alias("rows"), F.sum("calls").alias("calls"))


def gathered(*parts: DataFrame) -> DataFrame:
    """Results of groups as one table, whatever the order of their columns."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
