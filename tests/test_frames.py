"""Frames as a source: ranges, pushed conditions, and what is decoded at all."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.operators import scan
from glyphflow.sources import y4m


def film(path, n, layout="420jpeg", w=7, h=5, rate="25:2", light=None):
    down = y4m.LAYOUTS[layout]
    ph, pw = (0, 0) if down is None else (-(-h // down[1]), -(-w // down[0]))
    with open(path, "wb") as f:
        f.write(f"YUV4MPEG2 W{w} H{h} F{rate} Ip A1:1 C{layout}\n".encode())
        for i in range(n):
            y = np.full(w * h, (i if light is None else light) % 256, np.uint8)
            f.write(b"FRAME\n" + y.tobytes() + bytes([128]) * (2 * ph * pw))


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "v").mkdir()
    film(tmp_path / "v" / "one.y4m", 230)
    film(tmp_path / "v" / "two.y4m", 40, "mono")
    film(tmp_path / "v" / "none.y4m", 0, "444")
    (tmp_path / "v" / "notes.txt").write_text("x")
    return tmp_path / "v"


def test_colours(tmp_path):
    def one(layout, planes, w=2, h=2):
        return y4m.decoded(y4m.Video(w, h, 25.0, layout, 0, 1), bytes(planes))

    assert (one("mono", [1, 2, 3, 4])[..., 0] == [[1, 2], [3, 4]]).all()
    assert (one("420jpeg", [9] * 4 + [128, 128]) == 9).all() and (one("420", [235] * 4 + [128, 128]) == 255).all() and (one("420", [16] * 4 + [128, 128]) == 0).all()
    red = one("444", [81] * 4 + [90] * 4 + [240] * 4)[0, 0]
    assert red[2] > 250 and red[1] < 5 and red[0] < 5
    for layout in y4m.LAYOUTS:
        film(tmp_path / "x.y4m", 3, layout, 5, 3, light=100)
        found = list(y4m.read(str(tmp_path / "x.y4m"), [0, 2, 3, -1]))
        assert [n for n, *_ in found] == [0, 2] and found[0][2].shape == (3, 5, 3) and found[1][1] == 2 / 12.5
    (tmp_path / "x.y4m").write_bytes(b"RIFF")
    with pytest.raises(ValueError):
        list(y4m.read(str(tmp_path / "x.y4m"), [0]))


def test_ranges_equal_a_whole_read(spark, folder):
    spark.dataSource.register(y4m.Y4M)
    rows = lambda step: sorted(tuple(r) for r in spark.read.format("glyphflow_y4m").option("range", step).load(str(folder)).collect())
    whole = rows(10_000)
    assert len(whole) == 270 and rows(7) == whole and {r[0] for r in whole} == {"one", "two"}
    assert all(r[1] % 256 == r[5][0] and r[2] == r[1] / 12.5 and (r[3], r[4]) == (5, 7) for r in whole)
    assert spark.read.format("glyphflow_y4m").option("range", 7).load(f"file://{folder}/one.y4m").rdd.getNumPartitions() == 33


def test_conditions_are_pushed(spark, folder):
    spark.dataSource.register(y4m.Y4M)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("glyphflow_y4m").option("range", 10).option("push", "true").load(str(folder))
        some = load().where("video_id = 'one' and frame >= 100 and frame < 125")
        assert some.rdd.getNumPartitions() == 3 and sorted(r.frame for r in some.collect()) == list(range(100, 125))
        few = load().where(F.col("frame").isin(3, 37, 500) & F.col("video_id").isin("two", "one"))
        assert sorted((r.video_id, r.frame) for r in few.collect()) == [("one", 3), ("one", 37), ("two", 3), ("two", 37)]
        assert load().where("frame > 1000").count() == 0 and load().where("frame % 2 = 0").count() == 135
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_active_frames_are_decoded(spark, folder, tmp_path):
    """Regions that overlap, touch, lie apart or are of another video; each frame in one of them is decoded once."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def decoder(path, frames):
        for n, sec, bgr in y4m.read(path, frames):
            with open(seen / f"{os.path.basename(path)}-{n}", "a") as f:
                f.write("x")
            yield n, sec, bgr

    videos = spark.createDataFrame([(v, f"{folder}/{v}.y4m") for v in ("one", "two", "none")], "video_id string, path string")
    at = [("one", "roi_0", 10, 30), ("one", "roi_1", 20, 45), ("one", "roi_2", 46, 60), ("one", "roi_3", 200, 400), ("one", "roi_4", 22, 25), ("two", "roi_0", 5, 5), ("other", "roi_0", 0, 9), ("none", "roi_0", 0, 9)]
    regions = spark.createDataFrame([(v, r, "rect", "[0,0,4,4]", a, b) for v, r, a, b in at], "video_id string, roi_id string, type string, points string, start long, end long")
    want = {("one", n) for n in [*range(10, 61), *range(200, 230)]} | {("two", 5)}
    for chunk in (7, 1000):
        for p in seen.iterdir():
            p.unlink()
        frames = scan.read_active(videos, regions, decoder, chunk)
        got = [(r.video_id, r.frame) for r in frames.select("video_id", "frame", "image").collect()]
        assert len(got) == len(want) and set(got) == want
        assert {p.name: p.read_text() for p in seen.iterdir()} == {f"{v}.y4m-{n}": "x" for v, n in want}
    crops = scan.crops(scan.read_active(videos, regions), regions).collect()
    assert len(crops) == sum(len([n for v, n in want if v == own and a <= n <= b]) for own, _, a, b in at)
    wanted = spark.createDataFrame([("one", 5), ("one", 5), ("one", 229), ("one", 230), ("two", 39), ("other", 1)], "video_id string, frame int")
    assert sorted((r.video_id, r.frame) for r in scan.read_samples(videos, wanted).collect()) == [("one", 5), ("one", 229), ("two", 39)]
    assert scan.read_active(videos, regions.limit(0)).count() == 0


def test_intervals_meet_their_frames_once(spark):
    """Cells of frames: every pair of a frame and an interval that holds it, whatever the lengths, and none other."""
    import random

    from glyphflow.operators import intervals

    rnd = random.Random(3)
    spans = [(i, rnd.choice("ab"), a, a + rnd.choice([0, 1, 15, 16, 300, 5000])) for i, a in enumerate(rnd.randrange(9000) for _ in range(150))] + [(900, "a", 0, 40_000_000), (901, "a", 5, 4), (902, "b", 16, 31), (903, "b", 0, 0)]
    frames = [(v, n) for v in "abc" for n in sorted(rnd.sample(range(15_000), 300))] + [("a", 40_000_000), ("a", 40_000_001)]
    rois = spark.createDataFrame(spans, "key long, v string, start long, end long")
    at = spark.createDataFrame([(*f, "x") for f in frames], "v string, frame long, image string")
    want = sorted((v, n, k) for v, n in frames for k, own, a, b in spans if own == v and a <= n <= b)
    assert sorted((r.v, r.frame, r.key) for r in intervals.frame_join(at, rois, on=("v",)).collect()) == want
    counts = {(r.v, r.frame): (r.active, r.first_key) for r in intervals.active_counts(at, rois, "key", on=("v",)).collect()}
    assert counts == {f: (sum(w[:2] == f for w in want), min(w[2] for w in want if w[:2] == f)) for f in {w[:2] for w in want}}
    cells = rois.select("key", F.size(intervals.cells_of(F.col("start"), F.col("end"))).alias("n")).collect()
    assert all(r.n <= 30 * 6 for r in cells) and {r.key: r.n for r in cells}[901] == 0 and {r.key: r.n for r in cells}[902] == 1
