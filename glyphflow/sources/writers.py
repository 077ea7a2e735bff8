"""Sinks: subtitle files and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.functions import timefmt

#: Fixed values of the file format.
STYLE_FORMAT = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_FORMAT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
#: Name, font, share of the height in percent, outline, shadow, alignment.
STYLES = (("Default", "思源黑体 CN", 6, 2, 1, 2), ("CH", "思源黑体 CN", 6, 2, 1, 2), ("JP", "源ノ角ゴシック JP", 6, 2, 1, 2), ("KO", "Malgun Gothic", 6, 2, 1, 2), ("RU", "Arial", 6, 2, 1, 2), ("Top", "思源黑体 CN", 5, 2, 1, 8), ("Scene", "思源黑体 CN", 4, 1, 0, 5))


def header(title: str, width: int, height: int) -> str:
    lines = ["[Script Info]", f"Title: {title}", "ScriptType: v4.00+", "WrapStyle: 0", f"PlayResX: {width}", f"PlayResY: {height}", "ScaledBorderAndShadow: yes", "YCbCr Matrix: TV.709", "", "[V4+ Styles]", STYLE_FORMAT]
    lines += [f"Style: {n},{font},{height * share / 100:.0f},&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,{o},{s},{a},10,10,10,1" for n, font, share, o, s, a in STYLES]
    return "\n".join([*lines, "", "[Events]", EVENT_FORMAT, ""])


def dialogue(start: Column, end: Column, style: Column, tags: Column, body: Column) -> Column:
    return F.concat(F.lit("Dialogue: 0,"), start, F.lit(","), end, F.lit(","), style, F.lit(",,0,0,0,,"), tags, body)


def event_lines(events: DataFrame) -> DataFrame:
    """roi (and video), seq, start, line: from (roi, seq, start_sec, end_sec, style, tags, body) and, where there are, start_time and end_time."""
    text = lambda c: F.col(f"{c}_time") if f"{c}_time" in events.columns else timefmt.from_seconds(F.col(f"{c}_sec"))
    keys = [c for c in ("video", "roi") if c in events.columns]
    return events.select(*keys, "seq", text("start").alias("start"), dialogue(text("start"), text("end"), F.col("style"), F.col("tags"), F.col("body")).alias("line"))


def write_subtitles(events: DataFrame, path: str, head: str, numeric: bool = False) -> None:
    """A folder with one UTF-8 text file: header, then events by text of start (by seconds if ``numeric``), then roi and seq.

    A subtitle file is one file of one video, so a single task writes it; without events it holds the header alone.
    """
    lines = event_lines(events).withColumn("_at", timefmt.to_seconds(F.col("start")) if numeric else F.col("start"))
    order = ["_at", *[c for c in ("roi", "seq") if c in lines.columns]]
    spark = events.sparkSession
    first = spark.createDataFrame([(0, "\ufeff" + head.rstrip("\n"))], "part int, line string")
    rest = lines.select(F.lit(1).alias("part"), "line", *order)
    both = first.unionByName(rest, allowMissingColumns=True).repartition(1).sortWithinPartitions("part", *order)
    both.select("line").write.mode("overwrite").text(path)


def write_video_subtitles(events: DataFrame, videos: DataFrame, path: str, numeric: bool = False) -> None:
    """A subtitle file for each of ``videos`` (video, width, height; title and file, by default the video's name), in one job.

    Events (video, roi, seq and the columns of ``event_lines``) go by text of start (by seconds if ``numeric``), then roi
    and seq, after the header; a video without events has the header alone, and events of other videos are left out. Each
    file appears whole or not at all, and all of them only when the whole job is done (``files.LineFiles``); files that
    are there already are replaced, others stay.
    """
    from glyphflow.sources.files import LineFiles

    known = videos.dropDuplicates(["video"]).select("video", *(F.coalesce(F.col(c) if c in videos.columns else F.lit(None), F.col("video")).cast("string").alias(c) for c in ("title", "file")), "width", "height")
    lines = event_lines(events).withColumn("_at", timefmt.to_seconds(F.col("start")) if numeric else F.col("start"))
    order = ["_at", *[c for c in ("roi", "seq") if c in lines.columns]]
    body = lines.join(known.select("video", "file"), "video").select(F.concat("file", F.lit(".ass")).alias("file"), F.lit(1).alias("part"), "line", *order)
    # the header is a template whose heights are filled in for each video
    sizes = [F.format_string("%.0f", F.col("height") * share / 100) for _, _, share, *_ in STYLES]
    head = F.format_string(_header_template(), "title", F.col("width").cast("int"), F.col("height").cast("int"), *sizes)
    first = known.select(F.concat("file", F.lit(".ass")).alias("file"), F.lit(0).alias("part"), head.alias("line"))
    rows = first.unionByName(body, allowMissingColumns=True)
    events.sparkSession.dataSource.register(LineFiles)
    rows.repartition("file").sortWithinPartitions("file", "part", *order).select("file", "line").write.format(LineFiles.name()).mode("append").save(path)


def _header_template() -> str:
    """``header`` with places for the title, the size and the font sizes."""
    text = header("%s", 0, 0).rstrip("\n").replace("PlayResX: 0", "PlayResX: %d").replace("PlayResY: 0", "PlayResY: %d")
    for _, font, *_ in STYLES:
        text = text.replace(f"{font},0,", f"{font},%s,")
    return "\ufeff" + text


def write_records(records: DataFrame, path: str) -> None:
    """Recognised or restored frames as JSON, a folder for each roi."""
    records.write.mode("overwrite").partitionBy("roi_id").json(path)


def write_images(crops: DataFrame, path: str) -> None:
    """Crops (roi_id, frame_num, h, w, image) as Parquet, a folder for each roi."""
    crops.write.mode("overwrite").partitionBy("roi_id").parquet(path)


def region_json(regions: DataFrame) -> str:
    """The regions of one video as a JSON array in order of their position; ids aren't kept, they are positions."""
    import json

    rows = regions.withColumn("_at", F.regexp_extract("roi_id", r"(\d+)$", 1).cast("int")).orderBy("_at").drop("_at", "roi_id").toJSON().collect()  # as many as a person draws
    items = [json.loads(r) for r in rows]
    for r in items:
        if isinstance(r.get("points"), str):
            r["points"] = json.loads(r["points"])
    return json.dumps(items, ensure_ascii=False, indent=4)


def save_regions(regions: DataFrame, path: str) -> None:
    """Writes ``region_json`` to a file that others never see half written nor missing: a new name, then a rename over it."""
    spark = regions.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(path + ".part")
    fs = target.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(region_json(regions).encode())
        out.hsync()
    finally:
        out.close()
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.sc().hadoopConfiguration())
    options = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(part, target, options)


def settings_key(path: Column) -> Column:
    """The key under which settings of a video are kept."""
    return F.md5(path)


def save_settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, name, value: settings with those of ``new`` in place; a null value takes a setting away."""
    kept = old.join(new.select("key", "name"), ["key", "name"], "left_anti")
    return kept.unionByName(new.where("value is not null"))
