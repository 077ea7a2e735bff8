"""Frame scans: frames meet the regions active in them, and pixel kernels cut the crops.

Frames are rows (video_id, frame, time_sec, h, w, image), image being raw BGR bytes; ``read_active`` makes them, from
uncompressed videos or with whatever decodes others. Regions are rows of ``readers.regions`` with resolved bounds, of as many videos as there are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphflow.functions import timefmt
from glyphflow.operators import image, intervals

CROP = "video_id string, roi_id string, frame long, time_sec double, x1 int, y1 int, h int, w int, image binary"
MERGED = "roi_merged"


def bounds(regions: DataFrame, videos: DataFrame) -> DataFrame:
    """``regions`` of ``videos`` (video_id, fps, total_frames) with start and end frames: resolved, clamped, in order."""
    met = regions.join(videos.select("video_id", "fps", "total_frames"), "video_id")
    for side in ("start", "end"):
        at = timefmt.frame_number(F.col(f"{side}_frame"), F.col(f"{side}_time"), F.col("fps"))
        met = met.withColumn(f"_{side}", F.least(F.greatest(at, F.lit(0)), F.col("total_frames") - 1))
    return met.withColumns({"start": F.least("_start", "_end"), "end": F.greatest("_start", "_end")}).drop("_start", "_end", "fps", "total_frames")


def time_of(time_sec: Column, frame: Column, fps: Column) -> Column:
    """The decoder's time if it is positive, else the frame's, else 0."""
    return F.when(time_sec > 0, time_sec).when(fps > 0, frame / fps).otherwise(0.0)


def active(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """Frames with each region active in them: an equi-join on video and cell of frames."""
    own = regions.select("video_id", "roi_id", "type", "points", "start", "end", *[c for c in ("color_restrict", "blur_enabled") if c in regions.columns])
    return intervals.frame_join(frames, own, on=("video_id",))


Decoder = Callable[[str, list[int]], Iterator[tuple[int, float, object]]]


def active_ranges(regions: DataFrame, chunk: int = 250) -> DataFrame:
    """video_id, lo, hi: the frames in which some region of a video (video_id, start, end) is active, each once, in pieces
    of at most ``chunk``."""
    w = W.partitionBy("video_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= reach + 1, 0).otherwise(1)
    spans = regions.where("start <= end").withColumn("_o", opens).withColumn("_g", F.sum("_o").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("video_id", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    at = spans.withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor(F.col("end") / chunk))))
    return at.select("video_id", F.greatest("start", F.col("_k") * chunk).cast("long").alias("lo"), F.least("end", F.col("_k") * chunk + chunk - 1).cast("long").alias("hi"))


def _decoded(wanted: DataFrame, decoder: Decoder) -> DataFrame:
    """Rows of frames from (video_id, path, frames: array<long>), each row a range that one task reads."""
    from glyphflow.sources import y4m

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            for video, path, frames in zip(*(page.column(c).to_pylist() for c in range(3))):
                yield from y4m.batches(video, decoder(path, frames))

    return wanted.repartition("video_id", F.get("frames", F.lit(0))).mapInArrow(run, y4m.FRAME)


def read_active(videos: DataFrame, regions: DataFrame, decoder: Decoder | None = None, chunk: int = 250) -> DataFrame:
    """The frames of ``videos`` (video_id, path) in which some of ``regions`` (video_id, start, end) is active; no other frame
    is read or decoded.

    ``decoder`` gives (frame, seconds, BGR pixels) of the frames of a path that it is asked for, in order; by default that of
    uncompressed videos. A piece of ``chunk`` frames is read by one task, so a long video is read by many.
    """
    from glyphflow.sources import y4m

    ranges = active_ranges(regions, chunk).join(videos.select("video_id", "path"), "video_id")
    return _decoded(ranges.select("video_id", "path", F.sequence("lo", "hi").alias("frames")), decoder or y4m.read)


def read_samples(videos: DataFrame, wanted: DataFrame, decoder: Decoder | None = None, chunk: int = 250) -> DataFrame:
    """The single frames ``wanted`` (video_id, frame) of ``videos`` (video_id, path)."""
    from glyphflow.sources import y4m

    own = wanted.select("video_id", F.col("frame").cast("long").alias("frame")).distinct().groupBy("video_id", F.floor(F.col("frame") / chunk)).agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    return _decoded(own.join(videos.select("video_id", "path"), "video_id").select("video_id", "path", "frames"), decoder or y4m.read)


def _region(r: dict) -> dict:
    points = r["points"]
    restrict = r.get("color_restrict")
    return {"type": r["type"] or "rect", "points": json.loads(points) if points else None, "color_restrict": restrict.asDict(True) if hasattr(restrict, "asDict") else restrict, "blur_enabled": bool(r.get("blur_enabled"))}


def crops(frames: DataFrame, regions: DataFrame, outside: int = 0) -> DataFrame:
    """The crop of each region in each frame it is active in (``CROP``), preprocessed as the region asks for.

    What lies outside a polygon takes the value ``outside`` (0 in a sequential scan, 255 in a single read). Regions
    that are ill-formed or lie outside the frame give none.
    """
    import pandas as pd

    names = [c.split()[0] for c in CROP.split(", ")]

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            out = []
            for r in page.to_dict("records"):
                own = _region(r)
                cut = image.crop(image.decode(r["image"], r["h"], r["w"]), own["type"], own["points"], outside)
                if cut is not None:
                    bgr = image.preprocess(cut[0], own["color_restrict"], own["blur_enabled"])
                    out.append((r["video_id"], r["roi_id"], r["frame"], r["time_sec"], cut[2][0], cut[2][1], *bgr.shape[:2], bgr.tobytes()))
            yield pd.DataFrame(out, columns=names)

    return active(frames, regions).mapInPandas(run, CROP)


def single_crops(frames: DataFrame, regions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Crops of single frames, read by (video_id, roi_id, frame) whether or not the region is active there."""
    at = wanted.select("video_id", "roi_id", "frame").distinct()
    own = regions.drop("start", "end").join(at, ["video_id", "roi_id"]).withColumns({"start": F.col("frame"), "end": F.col("frame")}).drop("frame")
    return crops(frames.join(at.select("video_id", "frame").distinct(), ["video_id", "frame"], "left_semi"), own, outside=255)


def sample_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames (video_id, frame) of a sample; those that aren't there are passed over."""
    return frames.join(wanted.select("video_id", "frame").distinct(), ["video_id", "frame"], "left_semi")


def composites(frames: DataFrame, regions: DataFrame, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """One image (``CROP``, of region ``roi_merged``) for each frame with any active region: its regions' pixels alone.

    Regions are laid in order of their position in the list. They are few for each video and gathered without pixels.
    """
    import pandas as pd

    names = [c.split()[0] for c in CROP.split(", ")]
    order = F.regexp_extract("roi_id", r"(\d+)$", 1).try_cast("int")
    keep = [c for c in ("type", "points", "color_restrict", "blur_enabled") if c in regions.columns]
    slim = active(frames.select("video_id", "frame"), regions)
    own = slim.groupBy("video_id", "frame").agg(F.sort_array(F.collect_list(F.struct(order.alias("order"), "roi_id", F.to_json(F.struct(*keep)).alias("r")))).alias("regions"))

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            out = []
            for r in page.to_dict("records"):
                own = [_region({"points": None} | json.loads(x["r"])) for x in r["regions"]]
                bgr = image.composite(image.decode(r["image"], r["h"], r["w"]), own, background)
                out.append((r["video_id"], MERGED, r["frame"], r["time_sec"], 0, 0, r["h"], r["w"], bgr.tobytes()))
            yield pd.DataFrame(out, columns=names)

    return frames.join(own, ["video_id", "frame"]).mapInPandas(run, CROP)
