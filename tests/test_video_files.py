"""Many videos in one run: tracks apart, and a file for each."""

import os

import pytest
from pyspark.sql import functions as F

from glyphflow.plans import subtitles, views
from glyphflow.sources import files, writers


def test_videos_are_kept_apart(spark, tiny):
    """Two videos whose regions have the same ids give what each gives alone."""
    track = views.track(spark, tiny).where("roi < 24")
    both = track.withColumns({"video": F.concat(F.lit("v"), F.col("roi") % 2), "roi": F.floor(F.col("roi") / 2)})
    alone = sorted((f"v{r.roi % 2}", r.roi // 2, r.seq, r.start, r.line) for r in subtitles.dialogue(track).collect())
    found = subtitles.dialogue(both)
    assert found.columns == ["video", "roi", "seq", "start", "line"] and sorted(map(tuple, found.collect())) == alone
    unnamed = track.where("roi = 3").withColumns({"video": F.lit(None).cast("string"), "roi": F.lit(None).cast("long")})
    assert [r.line for r in subtitles.dialogue(unnamed).collect()] and subtitles.dialogue(unnamed).count() == subtitles.dialogue(track.where("roi = 3")).count()


def test_a_file_for_each_video(spark, tmp_path):
    """A thousand videos in one job; those without events have the header alone; others are left out."""
    events = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 1003).alias("video"), F.lit("roi_0").alias("roi"), F.col("id").alias("seq"), F.format_string("%d:00:0%d.00", F.col("id") % 11, F.col("id") % 7).alias("start_time"), F.lit("9:59:59.00").alias("end_time"), F.lit("Default").alias("style"), F.lit("").alias("tags"), F.concat(F.lit("é "), "id").alias("body"))
    videos = spark.range(1000).select(F.concat(F.lit("v"), "id").alias("video"), F.lit(640).alias("width"), (F.col("id") + 100).alias("height"), F.when(F.col("id") == 7, "Seven, %s").alias("title"), F.when(F.col("id") == 8, "deep/er").alias("file"))
    empty = spark.createDataFrame([("none", 1, 2, None, None)], "video string, width int, height long, title string, file string")
    path = str(tmp_path / "out")
    for _ in range(2):  # files that are there are replaced
        writers.write_video_subtitles(events, videos.unionByName(empty), path)
    names = sorted(os.listdir(path))
    assert len(names) == 1001 and "v0.ass" in names and "v1001.ass" not in names and os.listdir(f"{path}/deep") == ["er.ass"]
    read = lambda n: open(f"{path}/{n}.ass", encoding="utf-8-sig", newline="").read()
    assert read("none") == writers.header("none", 1, 2).rstrip("\n") and open(f"{path}/none.ass", "rb").read(3) == b"\xef\xbb\xbf"
    head = writers.header("Seven, %s", 640, 107).rstrip("\n")
    own = sorted((r.start_time, r.seq, f"Dialogue: 0,{r.start_time},{r.end_time},Default,,0,0,0,,{r.body}") for r in events.where("video = 'v7'").collect())
    assert read("v7") == "\n".join([head, *(line for *_, line in own)])
    writers.write_video_subtitles(events, videos.where("video = 'v7'"), str(tmp_path / "numeric"), numeric=True)
    assert [line.split(",")[1] for line in open(tmp_path / "numeric" / "v7.ass") if line.startswith("Dialogue")] == sorted((s for s, *_ in own), key=lambda s: int(s.split(":")[0]))


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(files.LineFiles)
    rows = spark.range(200).select(F.concat(F.lit("f"), F.col("id") % 40).alias("file"), F.when(F.col("id") == 177, F.raise_error("lost")).otherwise(F.lit("x")).cast("string").alias("line"))
    with pytest.raises(Exception):
        rows.repartition("file").sortWithinPartitions("file").write.format("glyphflow_lines").mode("append").save(str(tmp_path / "out"))
    left = os.listdir(tmp_path / "out") if os.path.isdir(tmp_path / "out") else []
    assert left == []
