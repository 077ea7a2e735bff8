"""Overlay or scene: scores from place, time, look and words, fused under a preset's weights."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions import text as T

#: Preset, kept (overlay, scene, unknown), weights (spatial, temporal, visual, semantic), bias, least
#: confidence (kept with the preset, without effect), category, whether a language model assists.
PRESETS = {
    "film_tv": ((True, False, False), (0.25, 0.25, 0.25, 0.25), 0.15, 0.25, "overlay_focused", False),
    "variety_show": ((True, False, False), (0.20, 0.20, 0.35, 0.25), 0.20, 0.25, "overlay_focused", False),
    "anime": ((True, True, False), (0.25, 0.25, 0.25, 0.25), 0.0, 0.35, "overlay_focused", False),
    "live_stream": ((True, False, False), (0.25, 0.25, 0.25, 0.25), 0.10, 0.25, "overlay_focused", False),
    "gameplay": ((True, False, False), (0.30, 0.30, 0.20, 0.20), 0.10, 0.35, "overlay_focused", False),
    "education": ((True, True, True), (0.25, 0.25, 0.25, 0.25), -0.05, 0.30, "both", True),
    "news": ((True, True, True), (0.20, 0.15, 0.25, 0.40), 0.0, 0.35, "both", True),
    "documentary": ((True, True, True), (0.25, 0.25, 0.25, 0.25), -0.05, 0.35, "both", False),
    "conference": ((True, True, True), (0.25, 0.35, 0.20, 0.20), -0.08, 0.35, "both", False),
    "short_video": ((True, True, False), (0.25, 0.25, 0.25, 0.25), 0.0, 0.35, "both", False),
    "surveillance": ((False, True, False), (0.25, 0.40, 0.20, 0.15), -0.25, 0.30, "scene_focused", False),
    "custom": ((True, True, True), (0.25, 0.25, 0.25, 0.25), 0.0, 0.35, "custom", False),
}
DEFAULT = "film_tv"
#: Without measured motion and look, these two scores are constants.
TEMPORAL, VISUAL = 0.5, -0.2
SURE = 0.85  # a layer whose score lies further from 0 gives its reason
ASSIST = 0.7  # below that confidence a language model is asked, if there is one


def presets(spark: SparkSession) -> DataFrame:
    """The presets as rows: preset, keep_overlay, keep_scene, keep_unknown, spatial, temporal, visual, semantic, bias, min_confidence, category, llm_assist."""
    rows = [(k, *kept, *weights, *rest) for k, (kept, weights, *rest) in PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, keep_overlay boolean, keep_scene boolean, keep_unknown boolean, spatial double, temporal double, visual double, semantic double, bias double, min_confidence double, category string, llm_assist boolean")


def with_preset(videos: DataFrame, column: str = "preset") -> DataFrame:
    """``videos`` with the settings of the preset each names; an unknown name gets nulls."""
    p = presets(videos.sparkSession).withColumnRenamed("preset", "_preset")
    return videos.join(F.broadcast(p), F.col(column) == F.col("_preset"), "left").drop("_preset")


def spatial_features(box: Column, width: Column, height: Column) -> dict[str, Column]:
    """rel_y, rel_height, edge (within 5 pixels of the frame's) and safe (bottom fifth, top 15 percent) of a box."""
    x1, y1, x2, y2 = (F.get(box, F.lit(k)) for k in range(4))
    tall = F.greatest(height, F.lit(1))
    rel_y = (y1 + y2) / 2 / tall
    return {"rel_y": rel_y, "rel_height": (y2 - y1) / tall, "edge": (x1 < 5) | (y1 < 5) | (x2 > width - 5) | (y2 > height - 5), "safe": (rel_y > 0.80) | (rel_y < 0.15)}


def spatial_score(rel_y: Column, rel_height: Column, edge: Column) -> Column:
    s = F.when(rel_y > 0.80, 0.6).when(rel_y < 0.15, 0.5).otherwise(0.0)
    s = s + F.when(edge, 0.2).otherwise(0.0) + F.when((rel_y > 0.25) & (rel_y < 0.70), -0.3).otherwise(0.0) + F.when(rel_height < 0.02, -0.2).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def temporal_score(duration: Column, still: Column, stability: Column, fades: Column) -> Column:
    s = F.when((duration > 1) & (duration < 8), 0.3).when(duration > 30, -0.4).otherwise(0.0)
    s = s + F.when(still, 0.2).otherwise(0.0) + F.when(stability < 0.3, 0.3).otherwise(0.0) + F.when(fades, 0.2).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def visual_score(stroke: Column, shadow: Column, box: Column, contrast: Column, perspective: Column, edge_density: Column, saturation_variance: Column) -> Column:
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    s = add(stroke, 0.35) + add(shadow, 0.25) + add(box, 0.3) + add(contrast > 0.7, 0.2) + add(perspective > 0.3, -0.4) + add(edge_density < 0.3, -0.2) + add(saturation_variance > 0.4, -0.15)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def fused(spatial: Column, semantic: Column, preset: str = "custom", temporal: Column | float = TEMPORAL, visual: Column | float = VISUAL, weights: dict[str, float] | None = None, bias: float | None = None) -> Column:
    """0 (scene) to 1 (overlay). ``weights`` and ``bias`` stand in for those of the preset; a layer without weight has 0.25."""
    own = dict(zip(("spatial", "temporal", "visual", "semantic"), PRESETS[preset][1])) if weights is None else weights
    w = lambda k: own.get(k, 0.25)
    raw = w("spatial") * spatial + w("temporal") * temporal + w("visual") * visual + w("semantic") * semantic + (PRESETS[preset][2] if bias is None else bias)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + 1) / 2))


def decide(score: Column) -> Column:
    return F.struct(F.when(score > 0.65, "overlay").when(score < 0.35, "scene").otherwise("unknown").alias("label"), F.when(score > 0.65, score).when(score < 0.35, 1 - score).otherwise(0.5).alias("confidence"))


def classify(lines: DataFrame, preset: str = "custom") -> DataFrame:
    """Adds label and confidence to lines with text, rel_y, rel_height and edge."""
    score = T.let(T.semantic(F.col("text")), lambda f: fused(spatial_score(F.col("rel_y"), F.col("rel_height"), F.col("edge")), T.semantic_score(f), preset))
    return lines.withColumn("_d", T.let(score, decide)).withColumns({"label": F.col("_d.label"), "confidence": F.col("_d.confidence")}).drop("_d")


def keep(classified: DataFrame, preset: str = "custom") -> DataFrame:
    """Lines whose label the preset keeps; lines without label stay."""
    kept = [k for k, on in zip(("overlay", "scene", "unknown"), PRESETS[preset][0]) if on]
    return classified.where(F.col("label").isNull() | (F.col("label") == "") | F.col("label").isin(kept))


def counters(classified: DataFrame, preset: str = "custom") -> DataFrame:
    """label, n, kept: lines of each label, and how many of them the preset keeps."""
    kept = [k for k, on in zip(("overlay", "scene", "unknown"), PRESETS[preset][0]) if on]
    stays = F.col("label").isNull() | (F.col("label") == "") | F.col("label").isin(kept)
    return classified.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(stays).alias("kept"))


#: What the layers say for themselves.
REASONS = {
    "bottom": "位于画面底部固定位置，符合后期叠加特征", "top": "位于画面顶部固定位置，符合后期叠加特征", "middle": "位于画面中央，可能为实拍场景文字",
    "rhythm": "持续时间 %.1fs 符合字幕节奏", "long": "长时间静止 (%.0fs)，可能为场景文字",
    "effects": "检测到后期特效特征：", "tilted": "存在透视变形，符合实拍特征", "visual": "视觉特征综合判定",
    "dialogue": "文本格式符合对白/台词模式", "sign": "文本内容为价格/地址等实拍信息", "semantic": "文本语义综合判定", "none": "综合特征判定",
}
EFFECTS = {"stroke": "描边", "shadow": "投影", "box": "背景色块"}


def rationale(scores: dict[str, Column], f: dict[str, Column]) -> Column:
    """The reasons of layers whose score is sure, joined, or the usual one.

    ``scores`` holds some of spatial, temporal, visual and semantic; ``f`` what they rest on: rel_y; duration; stroke,
    shadow, box, perspective; dialogue, price, address.
    """
    say = lambda k: F.lit(REASONS[k])
    effects = lambda: F.filter(F.array(*[F.when(f[k], F.lit(v)) for k, v in EFFECTS.items()]), lambda x: x.isNotNull())
    told = {
        "spatial": lambda s: F.when(s > 0, F.when(f["rel_y"] > 0.8, say("bottom")).otherwise(say("top"))).otherwise(say("middle")),
        "temporal": lambda s: F.when(s > 0, F.format_string(REASONS["rhythm"], f["duration"])).otherwise(F.format_string(REASONS["long"], f["duration"])),
        "visual": lambda s: F.when(F.size(effects()) > 0, F.concat(say("effects"), F.array_join(effects(), ", "))).when(f["perspective"] > 0.3, say("tilted")).otherwise(say("visual")),
        "semantic": lambda s: F.when(f["dialogue"] > 0.5, say("dialogue")).when(f["price"] | f["address"], say("sign")).otherwise(say("semantic")),
    }
    parts = [F.when(F.abs(scores[k]) > SURE, why(scores[k])) for k, why in told.items() if k in scores]
    joined = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "; ")
    return F.when(joined == "", say("none")).otherwise(joined)


def place(rel_y: Column, safe: Column) -> Column:
    """Where a line stands, in the words that a language model is given."""
    there = F.when(rel_y > 0.80, "bottom_safe_zone").when(rel_y < 0.15, "top_safe_zone").otherwise("unknown")
    return F.when(safe, there).when((rel_y > 0.25) & (rel_y < 0.70), "center_area").otherwise(F.format_string("y=%.0f%%", rel_y * 100))


def assist(classified: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """Lines with the client's label and confidence where the rules are unsure (``ASSIST``) and it has an answer.

    The client gets a JSON text with text, position and duration, and answers with JSON of source and confidence. An
    answer that can't be read, or an error, leaves the line as it is.
    """
    import json

    from glyphflow.operators import polish

    position = place(F.col("rel_y"), (F.col("rel_y") > 0.80) | (F.col("rel_y") < 0.15))

    @F.pandas_udf("label string, confidence double")
    def ask(text: pd.Series, where: pd.Series) -> pd.DataFrame:
        out = []
        for t, w in zip(text, where):
            found = polish.source_of(client, json.dumps({"text": t, "position": w, "duration_sec": 0.0, "nearby_texts": []}, ensure_ascii=False)) if t else None
            out.append(found or (None, None))
        return pd.DataFrame(out, columns=["label", "confidence"])

    unsure, sure = classified.where(F.col("confidence") < ASSIST), classified.where(~(F.col("confidence") < ASSIST) | F.col("confidence").isNull())
    asked = unsure.withColumn("_a", ask("text", position))
    named = asked.withColumns({"label": F.coalesce("_a.label", "label"), "confidence": F.coalesce("_a.confidence", "confidence")}).drop("_a")
    return sure.unionByName(named)
