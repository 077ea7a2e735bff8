"""Recognition by slices: batch and stream, whatever the cut into micro-batches."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.operators import image, vote
from glyphflow.streaming import recognition, slices

CROPS = "video string, roi string, frame long, time_sec double, h int, w int, image binary"


def reader():
    return lambda bgr: [] if bgr.sum() == 0 else [(str(int(bgr.sum())), 0.9, [0.0, 0.0, 1.0, 1.0], [[0.0, 0.0], [1.0, 1.0]])]


@pytest.fixture(scope="module")
def crops(spark):
    """Two videos with equal rois; looks that last longer than a slice, shorter ones, black frames."""
    rng = np.random.default_rng(0)
    looks = [np.zeros((12, 12, 3), np.uint8), *(rng.integers(0, 255, (12, 12, 3), dtype=np.uint8) for _ in range(5))]
    rows = []
    for video in ("a", "b"):
        for roi in ("roi_0", "roi_1"):
            look = 1
            for f in range(90):
                look = int(rng.integers(0, 6)) if rng.random() < 0.15 else look
                rows.append((video, roi, f, f * 0.1 if roi == "roi_0" else 0.0, 12, 12, looks[look].tobytes()))
    return spark.createDataFrame(rows, CROPS)


def spelt(rows):
    return sorted((r.video, r.roi, r.frame, r.time_sec, r.calls, tuple(m.text for m in r.lines)) for r in rows)


def test_slices_in_batch(crops):
    """Fresh slices are tracks of their own; shared ones know what the one before them ended with; no slices, one run."""
    whole, fresh, shared = (spelt(vote.skip_runs(crops, reader, **how).collect()) for how in ({}, {"slice_sec": 2.0, "fps": 10.0}, {"slice_sec": 2.0, "fps": 10.0, "shared": True}))
    own = crops.withColumn("roi", F.concat_ws("/", "roi", slices.bucket(F.col("time_sec"), F.col("frame"), 10.0, 2.0)))
    assert sorted(r[2:] for r in spelt(vote.skip_runs(own, reader).collect())) == sorted(r[2:] for r in fresh)
    reads = vote.Recogniser(reader, vote.STEP, vote.MOVED, vote.ALIKE, vote.DELTA, True)
    want, memory = [], {}
    rows = sorted((r.asDict() for r in crops.collect()), key=lambda r: (r["video"], r["roi"], r["frame"]))
    for key, part in itertools.groupby(rows, key=lambda r: (r["video"], r["roi"], int((r["time_sec"] or r["frame"] / 10) // 2))):
        memory = memory if key[2] else {}
        want += [(r["video"], r["roi"], r["frame"], r["time_sec"], calls, tuple(m["text"] for m in lines)) for r, lines, calls in reads.run(part, memory)]
    assert shared == sorted(want)
    calls = lambda rows: sum(r[4] for r in rows)
    assert len(whole) == 360 and calls(whole) < calls(fresh) < 360 and calls(shared) <= calls(fresh)


@pytest.mark.parametrize("shared", [True, False])
def test_stream_gives_the_rows_of_the_batch(spark, crops, tmp_path, shared):
    """In three cuts into micro-batches, one with a restart from the checkpoint after each of them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    want = spelt(vote.skip_runs(crops, reader, slice_sec=2.0, fps=10.0, shared=shared).collect())
    timed = crops.withColumn("ts", F.timestamp_seconds(F.col("frame") * 0.1 + 1000))
    ends = spark.createDataFrame([(v, r) for v in "ab" for r in ("roi_0", "roi_1")], "video string, roi string").selectExpr("*", "90L as frame", "cast(if(roi = 'roi_0', 9.0, 0.0) as double) as time_sec", "0 as h", "0 as w", "cast(null as binary) as image", "timestamp_seconds(1009) as ts")
    for n, cuts in enumerate(([90], [13, 27, 28, 60, 90], [44, 90])):
        source, out, at = tmp_path / f"in{n}", str(tmp_path / f"out{n}"), 0
        source.mkdir()

        def start():
            stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
            found = recognition.recognised(stream, reader, 2.0, fps=10.0, shared=shared)
            return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"check{n}")).trigger(availableNow=True).start()

        for cut in cuts:
            part = timed.where(f"frame >= {at} and frame < {cut}").orderBy(F.rand(3))
            (part.unionByName(ends) if cut == 90 else part).coalesce(1).write.parquet(str(source), mode="append")
            at = cut
            if n == 1:
                assert slices.ended(start(), lambda: False)
        if n != 1:
            assert slices.ended(start(), lambda: False)
        assert spelt(spark.read.parquet(out).collect()) == want


def test_watermark_ends_a_track(spark, crops, tmp_path):
    """Without a row that says so, the last slice goes out when the watermark has passed it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    one = crops.where("video = 'a' and roi = 'roi_0' and frame < 30").withColumn("ts", F.timestamp_seconds(F.col("frame") * 0.1 + 1000))
    far = one.limit(1).withColumns({"roi": F.lit("other"), "ts": F.timestamp_seconds(F.lit(9000))})
    for k, part in enumerate((one, far)):
        part.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = recognition.recognised(stream, reader, 2.0, fps=10.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert slices.ended(q, lambda: False)
        assert spark.read.parquet(str(tmp_path / "out")).count() == (20, 30)[k]


def test_changes_between_crops(spark):
    """Against the crop before: how much changed and how alike, a change of size, the first of a track, in any order."""
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 255, (9, 9, 3), dtype=np.uint8) for _ in range(3))
    rows = [("v", "r", 3, 0.0, 9, 9, b.tobytes()), ("v", "r", 1, 0.0, 9, 9, a.tobytes()), ("v", "r", 2, 0.0, 9, 9, a.tobytes()), ("w", "r", 2, 0.0, 9, 9, c.tobytes()), ("v", "r", 4, 0.0, 3, 27, b.tobytes())]
    got = {(r.video, r.frame): (r.changed, r.similarity) for r in vote.changes(spark.createDataFrame(rows, CROPS)).collect()}
    gray = image.gray
    assert got["v", 1] == got["w", 2] == (None, None) and got["v", 2] == (0.0, 1.0) and got["v", 4] == (1.0, 0.0)
    assert got["v", 3] == (image.changed_share(gray(a), gray(b), vote.DELTA), image.structural_similarity(gray(a), gray(b)))


def test_changes_in_stacks(spark):
    """Images of a batch are compared in stacks, each pair as it is alone, over several stacks; what isn't selected isn't computed."""
    rng = np.random.default_rng(3)
    sizes = [((9, 8), (9, 8), (6, 11), (0, 4))[k // 5 % 4] for k in range(200)]
    crops = [rng.integers(0, 256, (*s, 3), np.uint8) for s in sizes]
    rows = [("roi_0", k, k * 0.04, *s, bytearray(c.tobytes())) for k, (s, c) in enumerate(zip(sizes, crops))]
    found = vote.changes(spark.createDataFrame(rows, "roi string, frame long, time_sec double, h int, w int, image binary"))
    got = {r.frame: (r.changed, r.similarity) for r in found.collect()}
    grays = [image.gray(c) for c in crops]
    want = {k: (image.changed_share(a, b, vote.DELTA), image.structural_similarity(a, b)) for k, (a, b) in enumerate(zip(grays, grays[1:]), 1)}
    assert got == {0: (None, None)} | want
    assert {a.shape == b.shape for a, b in zip(grays, grays[1:])} == {True, False}
    assert found.select("changed")._jdf.queryExecution().optimizedPlan().toString().count("run(") == 1
    a, b = (rng.integers(0, 256, (50, 9, 12), np.uint8) for _ in range(2))
    assert [image.changed_share(x, y) for x, y in zip(a, b)] == image.changed_shares(a, b).tolist()
    assert [image.structural_similarity(x, y) for x, y in zip(a, b)] == image.structural_similarities(a, b).tolist()
