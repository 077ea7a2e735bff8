"""What kind of video: strong names, rules on features, prototypes blended with rules on metadata, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FEATURES = ("motion_intensity", "scene_cut_frequency", "text_density", "text_location_entropy", "static_ratio", "color_saturation", "letterbox_ratio", "multi_font_score")
#: Mean and deviation of each feature, in the order of FEATURES.
PROTOTYPES = {
    "film_tv": ((0.08, 0.25), (0.15, 0.1), (0.05, 0.02), (0.15, 0.08), (0.3, 0.15), (0.4, 0.15), (0.05, 0.05), (0.1, 0.08)),
    "variety_show": ((0.2, 0.15), (0.4, 0.2), (0.12, 0.05), (0.6, 0.2), (0.1, 0.08), (0.65, 0.15), (0.01, 0.02), (0.75, 0.15)),
    "anime": ((0.12, 0.15), (0.25, 0.15), (0.06, 0.03), (0.25, 0.15), (0.25, 0.15), (0.55, 0.2), (0.02, 0.03), (0.3, 0.2)),
    "education": ((0.04, 0.05), (0.05, 0.05), (0.15, 0.08), (0.5, 0.25), (0.6, 0.2), (0.35, 0.15), (0.01, 0.02), (0.4, 0.2)),
    "news": ((0.1, 0.1), (0.2, 0.12), (0.1, 0.04), (0.4, 0.2), (0.2, 0.12), (0.45, 0.15), (0.01, 0.02), (0.25, 0.15)),
    "documentary": ((0.06, 0.08), (0.08, 0.06), (0.04, 0.02), (0.3, 0.18), (0.45, 0.2), (0.4, 0.18), (0.03, 0.04), (0.15, 0.1)),
    "live_stream": ((0.18, 0.15), (0.03, 0.03), (0.1, 0.05), (0.55, 0.2), (0.15, 0.1), (0.55, 0.15), (0.01, 0.02), (0.6, 0.2)),
    "gameplay": ((0.3, 0.2), (0.08, 0.08), (0.08, 0.04), (0.45, 0.2), (0.1, 0.08), (0.5, 0.2), (0.01, 0.02), (0.45, 0.2)),
    "surveillance": ((0.02, 0.03), (0.0, 0.01), (0.02, 0.01), (0.1, 0.08), (0.85, 0.1), (0.15, 0.1), (0.0, 0.01), (0.05, 0.05)),
    "short_video": ((0.25, 0.2), (0.5, 0.3), (0.1, 0.06), (0.55, 0.25), (0.08, 0.05), (0.6, 0.2), (0.05, 0.08), (0.55, 0.2)),
    "conference": ((0.03, 0.04), (0.04, 0.04), (0.12, 0.06), (0.4, 0.2), (0.55, 0.25), (0.3, 0.15), (0.01, 0.02), (0.35, 0.2)),
}


#: Keywords of names, each of which counts for its preset.
KEYWORDS = {
    "film_tv": ("EP", "S01", "S02", "E01", "E02", "第", "集", "季", "1080p", "2160p", "BluRay", "WEB-DL", "NF", "Netflix", "HDR", "DDP", "中英双字", "BDRip", "WEBRip"),
    "anime": ("ANIME", "番", "字幕组", "BD", "TV", "OVA", "NCOP", "NCED", "アニメ", "メニュー"),
    "variety_show": ("综艺", "真人秀", "running", "奔跑", "脱口秀"),
    "education": ("教程", "课程", "Lecture", "课", "培训", "Tutorial", "入门", "实战", "系列", "Coursera"),
    "news": ("新闻", "News", "报道", "联播", "快讯"),
    "documentary": ("纪录片", "Documentary", "探索", "纪实", "National Geographic", "BBC", "CCTV"),
    "live_stream": ("直播", "Live", "录播", "回放", "实况", "Stream"),
    "gameplay": ("Game", "游戏", "实况", "攻略", "Playthrough", "boss", "通关"),
    "surveillance": ("cam", "CAM", "监控", "DVR", "ch0", "ch1", "camera", "IPC"),
    "short_video": ("抖音", "TikTok", "快手", "Reel", "Short", "vlog", "VLOG"),
    "conference": ("会议", "Conference", "演讲", "Keynote", "峰会", "论坛", "Webinar", "腾讯会议", "zoom", "teams"),
}
#: Names that settle the matter, with their confidence, in order.
STRONG = (
    (("监控", "cam01", "cam02", "dvr_", "ch01_", "ch02_", "ipc_", "nvr_"), "surveillance", 0.95),
    (("直播回放", "直播录播", "live_room", "douyu_", "huya_", "bilibili_live"), "live_stream", 0.92),
    (("会议录制", "zoom_", "teams_", "tencent_meeting", "webinar", "腾讯会议"), "conference", 0.90),
    (("gameplay", "playthrough", "boss战", "通关", "实况解说"), "gameplay", 0.88),
    (("抖音", "tiktok", "快手", "reel_", "short_"), "short_video", 0.85),
)
HIT = 0.30
NAME_SURE, RULE_SURE, NEAR_BEST = 0.90, 0.85, 0.85


def keyword_scores(name: Column) -> dict[str, Column]:
    """For each preset, ``HIT`` for every keyword that the name holds, in whatever case."""
    low = F.lower(name)
    return {k: HIT * sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0].lower())).cast("int")) for k, words in KEYWORDS.items()}


def strong_name(name: Column) -> Column:
    """(preset, confidence) of the first list with a word in the name, if it is sure enough to be returned; else null."""

    def match(low: Column) -> Column:
        found = F.lit(None).cast("struct<preset:string,confidence:double>")
        for words, preset, sure in reversed(STRONG):
            hit = F.contains(low, F.lit(words[0]))
            for w in words[1:]:
                hit = hit | F.contains(low, F.lit(w))
            found = F.when(hit, F.struct(F.lit(preset).alias("preset"), F.lit(sure).alias("confidence"))).otherwise(found)
        return F.when(found["confidence"] >= NAME_SURE, found)

    return match(F.lower(name))


#: The numbers in here are fixed values.
def metadata_scores(width: Column, duration: Column, aspect: Column, fps: Column, name: Column | None = None) -> dict[str, Column]:
    """Score of each kind that some rule names, or with a name, some keyword; rules add up."""
    wide, narrow = width >= 3840, (width < 3840) & (width <= 720)
    long, clip, brief = duration > 3600, duration < 60, (duration >= 60) & (duration < 300)
    tall, flat, old = aspect < 1.1, aspect > 2.0, (aspect > 1.3) & (aspect < 1.45)
    slow, film = fps < 15, (fps >= 23.9) & (fps <= 24.1)
    rules = {
        "film_tv": ((wide, 0.15), (long, 0.10), (flat, 0.25), (film, 0.15)),
        "documentary": ((wide, 0.10),),
        "surveillance": ((narrow, 0.25), (old, 0.15), (slow, 0.20)),
        "live_stream": ((narrow, 0.05), (tall, 0.20)),
        "conference": ((long, 0.15),),
        "education": ((long, 0.10), (old, 0.10)),
        "short_video": ((clip, 0.25), (brief, 0.10), (tall, 0.30)),
        "news": ((brief, 0.05),),
        "anime": ((film, 0.10),),
    }
    found = {k: sum((F.when(c, x).otherwise(0.0) for c, x in parts[1:]), F.when(parts[0][0], parts[0][1]).otherwise(0.0)) for k, parts in rules.items()}
    if name is None:
        return found
    named = keyword_scores(name)
    return {k: found.get(k, F.lit(0.0)) + named.get(k, F.lit(0.0)) for k in {**found, **named}}


def prototype_scores(meta: dict[str, Column] | None = None) -> list[Column]:
    """(preset, score, order) for each prototype: how near the features lie, blended with the score of the metadata."""
    parts = []
    for at, (preset, cells) in enumerate(PROTOTYPES.items()):
        square = sum((F.pow((F.col(f) - mean) / max(dev, 0.01), 2) for f, (mean, dev) in zip(FEATURES, cells)), F.lit(0.0))
        score = 0.7 * F.exp(-F.sqrt(square / len(cells))) + 0.3 * (meta or {}).get(preset, F.lit(0.0))
        parts.append(F.struct(F.lit(preset).alias("preset"), score.alias("score"), F.lit(at).alias("order")))
    return parts


def rank_prototypes(videos: DataFrame, id_col: str = "video_id", meta: dict[str, Column] | None = None) -> DataFrame:
    """id, preset, score, rank, near: all prototypes of each video, best first; near are the next three that come close
    to the best. The prototypes are literals, so nothing is joined."""
    rows = videos.select(id_col, F.explode(F.array(*prototype_scores(meta))).alias("p")).select(id_col, "p.preset", "p.score", "p.order")
    w = W.partitionBy(id_col).orderBy(F.desc("score"), "order")
    rows = rows.withColumns({"rank": F.row_number().over(w), "best": F.first("score").over(w)})
    return rows.select(id_col, "preset", "score", "rank", (F.col("rank").between(2, 4) & (F.col("score") > NEAR_BEST * F.col("best"))).alias("near"))


#: The numbers in here are fixed values.
def rule(f: dict[str, Column]) -> Column:
    """(preset, confidence) of the first rule that holds, if it is sure enough to be returned; else null."""
    is_ = lambda preset, sure: F.struct(F.lit(preset).alias("preset"), F.lit(sure).alias("confidence"))
    motion, cuts, still = f["motion_intensity"], f["scene_cut_frequency"], f["static_ratio"]
    fired = (
        F.when((motion < 0.02) & (cuts < 0.02) & (still > 0.80) & (f["color_histogram_spread"] < 0.25), is_("surveillance", 0.90))
        .when((f["multi_font_score"] > 0.65) & (cuts > 0.25) & (f["color_histogram_spread"] > 0.50), is_("variety_show", 0.85))
        .when((motion > 0.20) & (cuts < 0.10) & (f["letterbox_ratio"] < 0.02) & (still < 0.15), is_("gameplay", 0.82))
        .when((f["text_density"] > 0.10) & (still > 0.50) & (motion > 0.02) & (motion < 0.12), is_("education", 0.82))
        .when((f["letterbox_ratio"] > 0.03) & (f["aspect_ratio"] > 1.7) & (motion > 0.05) & (motion < 0.30), is_("film_tv", 0.85))
        .when((still < 0.12) & (cuts < 0.05) & (f["fps"] >= 25) & (f["text_location_entropy"] > 0.40), is_("live_stream", 0.80))
    )
    return F.when(fired["confidence"] >= RULE_SURE, fired)


def detect(videos: DataFrame) -> DataFrame:
    """video_id, preset, confidence, layer (name, rule or prototype), alternatives (up to three, near the best).

    From videos with file_name, width, duration_sec, aspect_ratio, fps and the features of ``features``, each where
    there is one row for each video; a missing feature counts as 0.
    """
    names = [*FEATURES, "color_histogram_spread"]
    v = videos.select("video_id", "file_name", "width", "duration_sec", "aspect_ratio", "fps", *[(F.coalesce(F.col(c), F.lit(0.0)) if c in videos.columns else F.lit(0.0)).alias(c) for c in names])
    meta = metadata_scores(F.col("width"), F.col("duration_sec"), F.col("aspect_ratio"), F.col("fps"), F.col("file_name"))
    every = F.array(*prototype_scores(meta))
    order = F.array_sort(F.transform(every, lambda p: F.struct((-p["score"]).alias("s"), p["order"].alias("o"), p["preset"].alias("preset"))))
    ranked = v.select("video_id", strong_name(F.col("file_name")).alias("n"), rule({c: F.col(c) for c in v.columns}).alias("r"), order.alias("p"))
    best = F.get("p", F.lit(0))
    near = F.transform(F.filter(F.slice("p", 2, 3), lambda x: x["s"] < best["s"] * NEAR_BEST), lambda x: x["preset"])
    layer = F.when(F.col("n").isNotNull(), "name").when(F.col("r").isNotNull(), "rule").otherwise("prototype")
    none = F.expr("cast(array() as array<string>)")
    return ranked.select("video_id", F.coalesce("n.preset", "r.preset", best["preset"]).alias("preset"), F.coalesce("n.confidence", "r.confidence", -best["s"]).alias("confidence"), layer.alias("layer"), F.when(layer == "prototype", near).when((layer == "rule") & (F.col("r.preset") == "surveillance"), F.array(F.lit("conference"))).when(layer == "rule", F.array(F.when(F.col("r.preset") == "variety_show", "short_video").otherwise("documentary"))).otherwise(none).alias("alternatives"))


def sample_list(total: Column, regions: Column | None = None) -> Column:
    """Frames to look at of a video of ``total`` frames, in order, 30 at most: the head, evenly over the body, the tail.

    A short video is sampled evenly alone. ``regions`` are (start, end) of which start, middle and end count too. Where
    there are more than 30, the last ones go.
    """
    none = F.expr("cast(array() as array<bigint>)")
    total = total.cast("long")
    short = F.when(total > 0, F.sequence(F.lit(0).cast("long"), total - 1, F.greatest(F.lit(1).cast("long"), F.floor(total / 20)))).otherwise(none)
    head = F.greatest(F.lit(1).cast("long"), F.floor(total * 0.05))
    tail = F.floor(total * 0.85)
    n = F.greatest(F.lit(15), F.least(F.lit(20), F.floor(total / 500)))
    body = F.when(tail > head, F.sequence(head, tail - 1, F.greatest(F.lit(1).cast("long"), F.floor((tail - head) / n)))).otherwise(none)
    ends = F.array(F.lit(0).cast("long"), F.floor(head / 2), head, tail, tail + F.floor((total - tail) / 2), total - 1)
    own = F.flatten(F.transform(regions, lambda r: F.array(r["start"].cast("long"), F.floor((r["start"] + r["end"]) / 2), r["end"].cast("long")))) if regions is not None else none
    return F.when(total <= 300, short).otherwise(F.slice(F.array_sort(F.array_distinct(F.concat(ends, body, F.coalesce(own, none)))), 1, 30))


def location_entropy(boxes: DataFrame, by: list[str], width: Column, height: Column) -> DataFrame:
    """by, entropy: how evenly the centres of boxes (x1, y1, x2, y2) lie over a grid of 5 x 5, 0 to 1."""
    cell = lambda a, b, side: F.least(F.lit(4), F.floor((F.col(a) + F.col(b)) / 2 / F.greatest(side, F.lit(1)) * 5).cast("int"))
    counts = boxes.groupBy(*by, cell("x1", "x2", width).alias("_x"), cell("y1", "y2", height).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    p = F.col("_n") / F.col("_all")
    return counts.join(total, by).groupBy(*by).agg((-F.sum(p * F.log2(p + 1e-10)) / F.log2(F.lit(25.0))).alias("entropy"))


def frame_features(frames: DataFrame) -> DataFrame:
    """video_id, frame, motion and cut (against the sampled frame before; null for the first), dark (above and below,
    left and right), color_saturation, color_histogram_spread, brightness_variance, text_density.

    Frames of a video are read by one task in order, which holds two of them; samples are 30 frames at most.
    """
    import pandas as pd

    from glyphflow.operators import image

    names = ["video_id", "frame", "motion", "cut", "letterbox_ratio", "pillar_box_ratio", "color_saturation", "color_histogram_spread", "brightness_variance", "text_density"]

    def run(pages):
        video, last = None, None
        for page in pages:
            out = []
            for r in page.to_dict("records"):
                bgr = image.decode(r["image"], r["h"], r["w"])
                now = image.gray(bgr)
                if r["video_id"] != video:
                    video, last = r["video_id"], None
                motion = image.changed_share(last, now, 25) if last is not None else None
                cut = last is not None and image.structural_similarity(last, now) < 0.3
                colours = image.colour_features(bgr)
                out.append((video, r["frame"], motion, cut, *image.dark_borders(now), *colours.values(), float(image.edges(now).mean())))
                last = now
            yield pd.DataFrame(out, columns=names)

    rows = frames.select("video_id", "frame", "h", "w", "image").repartition("video_id").sortWithinPartitions("video_id", "frame")
    return rows.mapInPandas(run, "video_id string, frame long, motion double, cut boolean, letterbox_ratio double, pillar_box_ratio double, color_saturation double, color_histogram_spread double, brightness_variance double, text_density double")


def features(per_frame: DataFrame, videos: DataFrame) -> DataFrame:
    """video_id and the features that ``detect`` takes, with motion_variance, scene_cut_count and pillar_box_ratio, from
    ``frame_features`` of sampled frames and videos (video_id, fps).

    Cuts are counted for each second that the samples would last; borders and colours are those of the first frame,
    text density is the mean of the first ten. multi_font_score and text_location_entropy aren't measured here: 0.
    """
    order = F.row_number().over(W.partitionBy("video_id").orderBy("frame"))
    own = per_frame.withColumn("at", order)
    first = lambda c: F.max(F.when(F.col("at") == 1, F.col(c))).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = own.groupBy("video_id").agg(
        zero(F.avg("motion")).alias("motion_intensity"), zero(F.var_pop("motion")).alias("motion_variance"), F.count_if("cut").alias("scene_cut_count"),
        zero(F.count_if(F.col("motion") < 0.005) / F.greatest(F.lit(1), F.count("motion"))).alias("static_ratio"), F.count(F.lit(1)).alias("n"),
        *map(first, ("letterbox_ratio", "pillar_box_ratio", "color_saturation", "color_histogram_spread", "brightness_variance")), zero(F.avg(F.when(F.col("at") <= 10, F.col("text_density")))).alias("text_density"),
    )
    lasts = F.greatest(F.lit(1.0), F.col("n") / F.greatest(F.col("fps"), F.lit(0.001)))
    return found.join(videos.select("video_id", "fps"), "video_id").withColumn("scene_cut_frequency", F.col("scene_cut_count") / lasts).withColumns({"multi_font_score": F.lit(0.0), "text_location_entropy": F.lit(0.0)}).drop("n", "fps")
