"""The driver's tables in the roles of tracks, lines, events, intervals, features and videos."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def seconds(name: str):
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))") / 1e6


def days(name: str):
    return F.expr(f"datediff(cast({name} as date), date'1992-01-01')").cast("long")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi, seq, frame, time_sec, text, score, x, y: events as recognised lines of one track for each user."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("roi"), F.col("event_id").alias("seq"), frame.alias("frame"), seconds("ts").alias("time_sec"), F.col("event_type").alias("text"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (k % 30).alias("x"), (k % 7).alias("y"))


#: Characters of a line that other scripts stand in for, so that lines of all scripts occur.
SCRIPTS = {1: "的一是不了", 2: "あいカタナ", 3: "аеиоу", 4: "가나다라마"}


#: What lines are dressed up with, in turn, so that they look like dialogue, prices, addresses and slogans.
DRESS = {1: ("Tom: ", ""), 2: ("", " $5 only"), 3: ("12 Main Street, ", ""), 4: ("", "！"), 5: ("「", "」"), 6: ("A1 B2 C3 ", " 88 元")}


def lines(spark: SparkSession, sf_dir: str, scripted: bool = False, dressed: bool = False) -> DataFrame:
    """doc_id, line_no, line: lines of documents; with ``scripted``, four of five have the vowels of another script; with
    ``dressed``, six of seven stand between the words of ``DRESS``."""
    d = table(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    at, line = F.col("doc_id") + F.col("line_no"), F.col("line")
    for k, letters in SCRIPTS.items() if scripted else ():
        line = F.when(at % 5 == k, F.translate("line", "aeiou", letters)).otherwise(line)
    for k, (head, tail) in DRESS.items() if dressed else ():
        line = F.when(at % 7 == k, F.concat(F.lit(head), "line", F.lit(tail))).otherwise(line)
    return rows.withColumn("line", line)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, word_no, word: what stands between spaces in documents."""
    d = table(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    return d.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("word_no", "word"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi, seq, frame, time_sec, text, score, x, y, top, height: one track for each user, two lines a frame.

    A text stays for some frames, now and then misread; the line that comes second stands above; frames are missing
    every so often; tracks lie at the bottom, at the top or between, one of four has no times, some lines are too tall.
    """
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    e = e.select(F.col("user_id").alias("roi"), F.col("event_id").alias("seq"), "value", n.alias("n"))
    pair, part = F.floor(F.col("n") / 2), F.col("n") % 2
    frame = pair + 3 * F.floor(pair / 9) + 1
    spell = F.floor(pair / 6)
    said = F.concat(F.when(part == 0, F.lit("Line ")).otherwise(F.lit("and then ")), (spell - spell % 2 + F.col("roi") % 7).cast("string"), F.when(F.col("roi") % 6 == 3, F.lit(" 字幕在这里继续显示出来")).otherwise(F.lit(" goes on.")))
    text = F.when(F.col("n") % 11 == 0, F.replace(said, F.lit("n"), F.lit("m"))).otherwise(said)
    base = F.element_at(F.array(F.lit(85), F.lit(4), F.lit(50)), (F.col("roi") % 3 + 1).cast("int"))
    off = F.when((F.col("roi") % 8 == 1) & (spell % 5 == 4), F.lit(-40)).otherwise(F.lit(0))
    top = (base + off + 6 * (1 - part)).cast("double")
    height = F.when(spell % 7 == 6, 12.0).when(F.col("roi") % 10 == 9, 0.0).otherwise(5.0)
    time = F.when(F.col("roi") % 4 == 3, 0.0).otherwise(frame * 0.04)
    score = F.when(F.col("value") > 99, 0.5).otherwise(0.9)
    return e.select("roi", "seq", frame.cast("long").alias("frame"), time.alias("time_sec"), text.alias("text"), score.alias("score"), (40.0 + F.col("n") % 5).alias("x"), (top + 2.5).alias("y"), top.alias("top"), height.alias("height"))


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi, seq, start_sec, end_sec, style, tags, body: each turn as three events, whole texts, with breaks as marks.

    The second has other spaces, the third lacks its first character. Conversations stand at the bottom or, one in
    three, as scenes that move a little, or in one of four a lot; in one of five, turns lie further apart, and in some the
    events of a turn lie far apart or overlap.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit("\\n")).alias("body"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    start = F.col("turn") * F.when(F.col("conv_id") % 5 == 4, 12.5).otherwise(7.5) + F.col("k") * F.when(F.col("conv_id") % 7 == 3, 6.503).when(F.col("conv_id") % 7 == 5, 1.5).otherwise(2.503)
    body = F.when(F.col("k") == 1, F.replace("body", F.lit(" "), F.lit("  "))).when(F.col("k") == 2, F.substring("body", 2, 2**31 - 1)).otherwise(F.col("body"))
    scene = F.col("conv_id") % 3 == 0
    tags = F.when(scene, F.format_string(r"{\an5\pos(%d,%d)}", F.col("turn") % 5 * 9 + F.col("k") * F.when(F.col("conv_id") % 4 == 1, 30).otherwise(1), 200 + F.col("k") * 11)).otherwise("")
    return c.select(F.col("conv_id").alias("roi"), (F.col("turn") * 3 + F.col("k")).cast("long").alias("seq"), start.cast("double").alias("start_sec"), (start + 2.0).cast("double").alias("end_sec"), F.when(scene, "Scene").otherwise("Default").alias("style"), tags.alias("tags"), body.alias("body"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events closer together, so that scenes follow each other at once."""
    e = subtitles(spark, sf_dir)
    start = F.col("start_sec") * 0.85
    return e.withColumns({"start_sec": start, "end_sec": start + 2.0})


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, kind, start, end: orders as intervals from their day to their last shipping day."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    last = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(days("l_shipdate")).alias("last"))
    return o.join(last, "o_orderkey", "left").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("kind"), days("o_orderdate").alias("start"), F.coalesce("last", days("o_orderdate")).alias("end"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi, group_id, y, height, location: order lines as text groups placed in a frame of 100 rows."""
    from glyphflow.operators.profile import location

    li = table(spark, sf_dir, "lineitem")
    y = (F.col("l_partkey") % 100).cast("int")
    rows = li.select((F.col("l_suppkey") % 500).alias("roi"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("group_id"), y.alias("y"), (F.col("l_quantity").cast("int") % 40).alias("height"))
    return rows.withColumn("location", location(F.col("y"), F.lit(100)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphflow.operators.detect import FEATURES

    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("video_id"), *[F.abs(F.get("embedding", F.lit(i)).cast("double")).alias(f) for i, f in enumerate(FEATURES)])


#: Names of videos, in turn: some settle the matter, some hold keywords, some nothing.
NAMES = ("cam01_yard.mp4", "zoom_call.mkv", "Show.S01E01.1080p.mkv", "holiday.mov", "BOSS战.mp4", "news_live.mp4", "第3集 字幕组.mkv", "reel_9.mp4", "lecture 4.avi")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, file_name, width, duration_sec, aspect_ratio, fps and features: of one in ten, those of surveillance, of
    one in ten, those of films."""
    from glyphflow.operators.detect import FEATURES

    v, k = features(spark, sf_dir).withColumn("color_histogram_spread", F.lit(0.6)), F.col("video_id")
    still, film = k % 10 == 3, k % 10 == 6
    name = F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int"))
    fix = {"motion_intensity": (0.01, 0.1), "scene_cut_frequency": (0.0, 0.2), "static_ratio": (0.9, 0.3), "color_histogram_spread": (0.1, 0.5), "letterbox_ratio": (0.0, 0.2), "text_density": (0.0, 0.01), "multi_font_score": (0.0, 0.0)}
    v = v.withColumns({c: F.when(still, a).when(film, b).otherwise(F.col(c)) for c, (a, b) in fix.items()})
    return v.select(k, name.alias("file_name"), (k % 9 * 600).cast("int").alias("width"), (k % 100 * 50.0).alias("duration_sec"), (0.9 + k % 14 * 0.1).alias("aspect_ratio"), (10.0 + k % 20).alias("fps"), *FEATURES, "color_histogram_spread")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, key, x1, y1, x2, y2: order lines as boxes in a frame of 640 x 360."""
    li = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 640).cast("int"), (F.col("l_suppkey") * 7 % 360).cast("int")
    w, h = F.col("l_quantity").cast("int") * 2, F.col("l_quantity").cast("int") % 12
    return li.select((F.col("l_orderkey") % 50).alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi, frame, h, w, image: events as grey crops of 8 x 8 pixels, one track for each user; pixels move every third frame."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    e = e.select(F.col("user_id").alias("roi"), n.alias("frame"))
    pixel = lambda i: F.repeat(F.lpad(F.hex((F.col("roi") * 7 + F.floor(F.col("frame") / 3) * 13 * (i % 5) + i) % 256), 2, "0"), 3)
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), pixel), ""))
    return e.select("roi", "frame", F.lit(8).alias("h"), F.lit(8).alias("w"), data.alias("image"))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, roi_id, ratio: order lines as the shares of colour of regions in frames."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 20).cast("string").alias("video_id"), F.col("l_orderkey").alias("frame"), F.concat(F.lit("roi_"), F.col("l_linenumber")).alias("roi_id"), (F.col("l_discount") * F.col("l_quantity") / 10).alias("ratio"))
