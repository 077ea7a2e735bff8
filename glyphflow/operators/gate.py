"""The colour gate: frames whose regions show enough of the colours that text has."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.operators import image, intervals, scan


def ratios(frames: DataFrame, regions: DataFrame, colours: list[tuple]) -> DataFrame:
    """video_id, frame, roi_id, ratio: the share of a region's pixels whose colour lies in any of the bounds.

    Regions that are ill-formed, outside the frame, or polygons of under three points have ratio 0.
    """
    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            found = []
            for r in page.to_dict("records"):
                own = scan._region(r)
                cut = image.crop(image.decode(r["image"], r["h"], r["w"]), own["type"], own["points"], least=3)
                found.append(0.0 if cut is None else image.presence_share(cut[0], cut[1], colours))
            yield page[["video_id", "frame", "roi_id"]].assign(ratio=found)

    return scan.active(frames, regions).mapInPandas(run, "video_id string, frame long, roi_id string, ratio double")


def passing(ratios_: DataFrame, least: float) -> DataFrame:
    """Rows of ``ratios`` that pass."""
    return ratios_.where(F.col("ratio") >= least)


def frames_passing(ratios_: DataFrame, least: float) -> DataFrame:
    """video_id, frame, passed (any region passes), max_ratio."""
    return ratios_.groupBy("video_id", "frame").agg(F.max(F.col("ratio") >= least).alias("passed"), F.greatest(F.max("ratio"), F.lit(0.0)).alias("max_ratio"))


def recount(preview: DataFrame, least: float) -> DataFrame:
    """video_id, kept: preview rows that another bound would keep."""
    return preview.groupBy("video_id").agg(F.count_if(F.col("max_ratio") >= least).alias("kept"))


def statistics(preview: DataFrame, planned: DataFrame) -> DataFrame:
    """video_id, kept, sampled, keep_ratio, planned, estimated: what a gate would keep of the planned frames, one at least."""
    s = preview.groupBy("video_id").agg(F.count_if("passed").alias("kept"), F.count(F.lit(1)).alias("sampled"))
    s = s.withColumn("keep_ratio", F.col("kept") / F.col("sampled")).join(planned.select("video_id", "planned"), "video_id")
    return s.withColumn("estimated", F.greatest(F.lit(1), F.rint(F.col("planned") * F.col("keep_ratio")).cast("long")))


def calibration_region(regions: DataFrame, at: DataFrame) -> DataFrame:
    """video_id, frame, position: the first region in the list that is active at a frame (video_id, frame), or -1."""
    n = F.regexp_extract("roi_id", r"(\d+)$", 1).try_cast("int")
    first = intervals.active_counts(at, regions.select("video_id", n.alias("n"), "start", "end"), "n", on=("video_id",))
    return at.join(first, ["video_id", "frame"], "left").groupBy("video_id", "frame").agg(F.coalesce(F.min("first_key"), F.lit(-1)).alias("position"))


def calibrated(crops: DataFrame, margin: float = 15) -> DataFrame:
    """Adds bounds, (lower, upper) in HSV of a saturated and of a light colour, to crops (h, w, image; mask or null)."""
    schema = "array<struct<lower:array<int>,upper:array<int>>>"

    @F.pandas_udf(schema)
    def bounds(h: pd.Series, w: pd.Series, data: pd.Series, mask: pd.Series) -> pd.Series:
        def one(h: int, w: int, data: bytes, mask: bytes | None) -> list[dict]:
            import numpy as np

            own = np.frombuffer(mask, np.uint8) if mask is not None else None
            return [{"lower": list(lo), "upper": list(hi)} for lo, hi in image.calibrate(image.decode(data, h, w), own, margin)]

        return pd.Series([one(*r) for r in zip(h, w, data, mask)])

    mask = F.col("mask") if "mask" in crops.columns else F.lit(None).cast("binary")
    return crops.withColumn("bounds", bounds("h", "w", "image", mask))


def masked_crops(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """video_id, roi_id, frame, h, w, image, mask (0 or 255): crops without preprocessing, for calibration."""
    names = ["video_id", "roi_id", "frame", "h", "w", "image", "mask"]

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            out = []
            for r in page.to_dict("records"):
                own = scan._region(r)
                bgr = image.decode(r["image"], r["h"], r["w"])
                cut = image.crop(bgr, own["type"], own["points"], least=3)
                if cut is not None:
                    x1, y1, x2, y2 = cut[2]
                    out.append((r["video_id"], r["roi_id"], r["frame"], y2 - y1, x2 - x1, bgr[y1:y2, x1:x2].tobytes(), (cut[1] * 255).astype("uint8").tobytes()))
            yield pd.DataFrame(out, columns=names)

    return scan.active(frames, regions).mapInPandas(run, "video_id string, roi_id string, frame long, h int, w int, image binary, mask binary")
