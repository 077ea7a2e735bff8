"""Sources: videos, regions, recognised frames, image folders, style templates, prompts, logs."""

from __future__ import annotations

from string import Template

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

COLOURS = "struct<enabled:boolean,text_bgr:array<int>,outline_bgr:array<int>,shadow_bgr:array<int>,tolerance:int,morph_kernel:int>"
REGION = f"struct<start_time:string,end_time:string,start_frame:int,end_frame:int,type:string,points:string,color_restrict:{COLOURS},blur_enabled:boolean,fade_in_refine_enabled:boolean>"
RECORD = "roi_id string, frame_num int, time_sec double, rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, dt_polys array<array<array<double>>>, rec_polys array<array<array<double>>>"
VIDEO = "video_id string, path string, fps double, total_frames int, width int, height int"
#: Fields of a style line, in order.
STYLE_FIELDS = ("Name", "Fontname", "Fontsize", "PrimaryColour", "SecondaryColour", "OutlineColour", "BackColour", "Bold", "Italic", "Underline", "StrikeOut", "ScaleX", "ScaleY", "Spacing", "Angle", "BorderStyle", "Outline", "Shadow", "Alignment", "MarginL", "MarginR", "MarginV", "Encoding")
#: What a file has after its styles.
EVENTS_TAIL = "\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
#: Endings of the names of video files.
VIDEO_KINDS = ("mp4", "avi", "mov", "mkv")


def videos(spark: SparkSession, path: str) -> DataFrame:
    """Videos of a manifest, a JSON object a line: what a decoder says of each file. Other kinds of files are left out.

    file_name and the folder's saved regions (regions_path) follow from the path, aspect_ratio and duration_sec from the rest.
    """
    v = spark.read.schema(VIDEO).json(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    known = v.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*VIDEO_KINDS))
    return known.withColumns({"file_name": name, "regions_path": F.concat(stem, F.lit("_roi_autosave.json")), "aspect_ratio": F.col("width") / F.greatest(F.col("height"), F.lit(1)), "duration_sec": F.when(F.col("fps") > 0, F.col("total_frames") / F.col("fps")).otherwise(0.0)})


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of JSON files that hold an array each: file, roi_id (the position in the array) and the entry's fields.

    points stays JSON, since rectangles and polygons differ. Entries that aren't objects have null fields.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.from_json("value", "array<string>")).alias("at", "entry"))
    return raw.select("file", F.concat(F.lit("roi_"), F.col("at")).alias("roi_id"), F.from_json("entry", REGION).alias("r")).select("file", "roi_id", "r.*")


def edited(regions_: DataFrame, remove: int | None = None, insert: DataFrame | None = None, after: int | None = None) -> DataFrame:
    """The regions of one file without the one at ``remove``, or with those of ``insert`` after the one at ``after`` (at
    the end without it); positions are counted anew, so later ids move."""
    at = F.regexp_extract("roi_id", r"(\d+)$", 1).cast("double")
    rows = regions_.withColumn("_at", at)
    if remove is not None:
        rows = rows.where(F.col("_at") != remove)
    if insert is not None:
        end = F.lit(float("inf")) if after is None else F.lit(after + 0.5)
        rows = rows.unionByName(insert.withColumn("_at", end), allowMissingColumns=True)
    order = F.row_number().over(W.partitionBy("file").orderBy("_at", "roi_id"))
    return rows.withColumn("roi_id", F.concat(F.lit("roi_"), order - 1)).drop("_at")


def records(spark: SparkSession, path: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """Recognised frames, a JSON object a line or a file each; what can't be read is left out."""
    return spark.read.schema(RECORD).option("mode", mode).json(path)


def record_stream(spark: SparkSession, path: str, files: int = 2) -> DataFrame:
    """The same as a stream; a micro-batch takes ``files`` files at most, so that a slow reader is never flooded."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", max(1, files)).option("mode", "DROPMALFORMED").json(path)


def referred(spark: SparkSession, refs: DataFrame, path: str) -> DataFrame:
    """Records of refs (roi_id, frame_num, time_sec, path): what the JSON file of that path holds; missing files give none.

    A path that isn't absolute is one below ``path``. The join is by the whole path, so files of one name in many folders
    don't meet.
    """
    body = ", ".join(c for c in RECORD.split(", ") if c.split()[0] not in ("roi_id", "frame_num", "time_sec"))
    plain = lambda c: F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")  # noqa: E731  without scheme and host
    stored = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(plain(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))).alias("_file"), F.from_json("value", body).alias("r"))
    root = F.lit(path.rstrip("/") + "/")
    at = plain(F.when(F.col("path").rlike(r"^(/|[a-zA-Z][a-zA-Z0-9+.-]*:)"), F.col("path")).otherwise(F.concat(root, "path")))
    return refs.withColumn("_file", at).join(stored, "_file").select("roi_id", "frame_num", "time_sec", "r.*")


def lines(records_: DataFrame) -> DataFrame:
    """roi_id, frame_num, time_sec, line_idx, text, score, box, polygon: a row for each line of frames whose four arrays
    are of one length; coordinates are cut towards zero."""
    names = ("rec_texts", "rec_scores", "rec_boxes", "rec_polys")
    same = F.lit(True)
    for n in names[1:]:
        same = same & (F.size(names[0]) == F.size(n))
    z = records_.where(same).select("roi_id", "frame_num", "time_sec", F.posexplode(F.arrays_zip(*names)).alias("line_idx", "z"))
    return z.select("roi_id", "frame_num", "time_sec", "line_idx", F.col("z.rec_texts").alias("text"), F.col("z.rec_scores").alias("score"), F.col("z.rec_boxes").cast("array<int>").alias("box"), F.col("z.rec_polys").cast("array<array<int>>").alias("polygon"))


def track(lines_: DataFrame) -> DataFrame:
    """Lines as the main query takes them: roi, seq, frame, time_sec, text, score, x, y (centre), top, height."""
    from glyphflow.functions import geometry

    at = geometry.centre(F.col("polygon"))
    seq = F.col("frame_num").cast("long") * 10_000 + F.col("line_idx")
    return lines_.select(F.col("roi_id").alias("roi"), seq.alias("seq"), F.col("frame_num").cast("long").alias("frame"), "time_sec", "text", "score", at["x"].alias("x"), at["y"].alias("y"), F.get("box", F.lit(1)).cast("double").alias("top"), (F.get("box", F.lit(3)) - F.get("box", F.lit(1))).cast("double").alias("height"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """folder, roi_id (file_0, file_1, ... in order of a folder's names), path, content of jpg, jpeg and png files.

    The order is that of one folder's names, without contents, so a single window over them holds names alone. Every folder
    has a file_0: folder and roi_id together are the key.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(path).select("path", "content")
    names = found.select("path", F.regexp_extract("path", "^(.*)/", 1).alias("folder"))
    names = names.withColumn("roi_id", F.concat(F.lit("file_"), F.row_number().over(W.partitionBy("folder").orderBy("path")) - 1))
    return found.join(names, "path").select("folder", "roi_id", "path", "content")


def template_header(text: Column, width: Column, height: Column) -> Column:
    """The part of a template before its events, with the play size set, and the head of its events."""
    head = F.get(F.split(text, r"\[Events\]", 2), 0)
    sized = F.regexp_replace(head, F.lit("(?im)^PlayResX:.*$"), F.concat(F.lit("PlayResX: "), width.cast("string")))
    sized = F.regexp_replace(sized, F.lit("(?im)^PlayResY:.*$"), F.concat(F.lit("PlayResY: "), height.cast("string")))
    return F.concat(F.regexp_replace(sized, r"^\s+|\s+$", ""), F.lit(EVENTS_TAIL))


def styles(text: Column) -> Column:
    """array of structs of all ``STYLE_FIELDS`` (text): the style lines of a template, repeated names kept."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^Style:\s*(.*?)\s*$"), F.lit(1))
    return F.transform(found, lambda s: F.struct(*[F.trim(F.get(F.split(s, ",", -1), F.lit(k))).alias(n) for k, n in enumerate(STYLE_FIELDS)]))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """name (the path below ``path`` without ending), text: the Markdown files there, but for README."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    base = F.regexp_extract(F.input_file_name(), rf"{path.rstrip('/').split('/')[-1]}/(.*)\.md$", 1)
    return found.select(base.alias("name"), F.col("value").alias("text")).where(~F.col("name").rlike("(^|/)README$"))


def filled(prompt: str, **values: str) -> str:
    """A prompt with its $variables filled in; unknown ones stay."""
    return Template(prompt).safe_substitute(values)


def freeze_segments(log: DataFrame) -> DataFrame:
    """video_id, start_sec, end_sec of a filter log (video_id, seq, line): each end with the start before it, once."""
    value = lambda k: F.regexp_extract("line", rf"freeze_{k}:\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    w = W.partitionBy("video_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    marked = log.withColumns({"s": value("start"), "e": value("end")}).where("s is not null or e is not null")
    # the line before is a start, or the end has no start of its own
    was = marked.withColumn("before", F.last(F.struct("s", F.col("s").isNull().alias("spent"))).over(w))
    pairs = was.where("s is null and e is not null and before is not null and not before.spent").select("video_id", F.col("before.s").alias("start_sec"), F.col("e").alias("end_sec"))
    return pairs.where("end_sec >= start_sec")


def segment_times(segments: DataFrame, k: int = 2, margin: float = 0.03) -> DataFrame:
    """``segments`` with a row for each of ``k`` times spread evenly within the margins; the middle if they leave no room."""
    k, margin = max(1, k), max(0.0, margin)
    s, e = F.col("start_sec") + margin, F.col("end_sec") - margin
    spread = F.array((s + e) / 2) if k == 1 else F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: s + (e - s) * i / (k - 1))
    middle = F.array((F.col("start_sec") + F.col("end_sec")) / 2)
    return segments.where("end_sec > start_sec").withColumn("time_sec", F.explode(F.when(e <= s, middle).otherwise(spread)))


def restored(records_: DataFrame, offsets: DataFrame) -> DataFrame:
    """Records in the coordinates of the video: shifted by their region's offset (roi_id, type, points; full_frame).

    Records without text pass as they are; those with text whose region has no offset are left out.
    """
    from glyphflow.functions import geometry

    full = F.col("full_frame") if "full_frame" in offsets.columns else F.lit(False)
    o = offsets.select("roi_id", geometry.offset(F.col("type"), F.col("points"), F.coalesce(full, F.lit(False))).alias("_o"))
    met = records_.join(o, "roi_id", "left")
    text = F.size("rec_texts") > 0
    dx, dy = F.col("_o.dx"), F.col("_o.dy")
    moved = {"dt_polys": geometry.shift_polygons, "rec_polys": geometry.shift_polygons, "rec_boxes": geometry.shift_boxes}
    shifted = met.where(~F.coalesce(text, F.lit(False)) | F.col("_o").isNotNull())
    return shifted.withColumns({c: F.when(text, f(F.col(c), dx, dy)).otherwise(F.col(c)) for c, f in moved.items()}).drop("_o")
