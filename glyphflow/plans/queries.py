"""Registered queries of the library's own operators, each with its SQL."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphflow.functions import geometry, timefmt
from glyphflow.functions import text as T
from glyphflow.operators import classify, detect, engines, gate, intervals, merge, polish, profile, refine, segment, vote
from glyphflow.plans import sql, subtitles, views
from glyphflow.sources import readers, writers
from glyphflow.streaming import slices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SPACE = T.SPACE
EV, LINES, ROIS, GROUPS, SUBS = sql.EV, sql.LINES, sql.ROIS, sql.GROUPS, sql.SUBS


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


@query(f"WITH {ROIS} SELECT kind, count(*) AS n_rois, CAST(sum(greatest(a, b) - least(a, b) + 1) AS BIGINT) AS planned FROM (SELECT kind, least(greatest(s, 0), 2499) AS a, least(greatest(e, 0), 2499) AS b FROM rois) GROUP BY kind")
def planned_frames(spark, sf):
    return intervals.planned(intervals.clamp(views.intervals(spark, sf), 2500), ["kind"])


@query(f"WITH {ROIS} SELECT kind, count(DISTINCT f) AS covered FROM rois, unnest(generate_series(least(s, e), greatest(s, e))) AS t(f) GROUP BY kind")
def interval_union_count(spark, sf):
    return intervals.union_count(intervals.clamp(views.intervals(spark, sf), 1_000_000), ["kind"])


@query(f"WITH {ROIS}, d AS (SELECT DISTINCT date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS frame FROM lineitem) SELECT frame, count(*) AS active, min(key) AS first_key FROM d JOIN rois ON frame BETWEEN least(s, e) AND greatest(s, e) GROUP BY frame")
def interval_frame_join(spark, sf):
    frames = views.table(spark, sf, "lineitem").select(views.days("l_shipdate").alias("frame")).distinct()
    return intervals.active_counts(frames, intervals.clamp(views.intervals(spark, sf), 1_000_000), "key")


@query(f"WITH {ROIS}, b AS (SELECT kind, min(least(s, e)) AS lo, max(greatest(s, e)) AS hi FROM rois GROUP BY kind), n AS (SELECT *, least(48, hi - lo + 1) AS n FROM b) SELECT DISTINCT kind, CAST(floor(lo + i * ((hi - lo) / CAST(n - 1 AS DOUBLE))) AS BIGINT) AS frame FROM n, unnest(generate_series(0, n - 1)) AS t(i)")
def probe_frames(spark, sf):
    return intervals.probe_frames(intervals.clamp(views.intervals(spark, sf), 1_000_000), ["kind"])


@query(f"WITH {EV} SELECT * FROM ev WHERE score >= 0.6 AND NOT regexp_full_match(text, '{SPACE}*')")
def score_blank_filter(spark, sf):
    return segment.readable(views.observations(spark, sf))


@query(f"WITH {EV} SELECT roi, CAST(floor(time_sec / 3600) AS BIGINT) AS frame, coalesce(arg_min(time_sec, seq) FILTER (time_sec > 0), 0.0) AS time_sec, string_agg(text, '|' ORDER BY seq) AS texts FROM ev WHERE score >= 0.6 GROUP BY 1, 2")
def group_lines(spark, sf):
    rows = segment.readable(views.observations(spark, sf)).withColumn("frame", F.floor(F.col("time_sec") / 3600))
    return segment.frames(rows).select("roi", "frame", "time_sec", F.array_join(F.transform("lines", lambda m: m["text"]), "|").alias("texts"))


@query(f"WITH RECURSIVE {sql.RUNS} SELECT roi, row_number() OVER (PARTITION BY roi ORDER BY start_frame) - 1 AS group_id, start_frame, end_frame, CAST(n_frames AS BIGINT) AS n_frames FROM runs")
def anchor_segments(spark, sf):
    return segment.segments(segment.frames(segment.readable(views.track(spark, sf))))


@query(f"WITH {LINES} SELECT doc_id, line_no, {sql.canonical('line')} AS canonical FROM lines")
def canonical_text(spark, sf):
    return views.lines(spark, sf).select("doc_id", "line_no", T.canonical(F.col("line")).alias("canonical"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(text, '\\[nrt]|\r\n|[\r\n\t\x{{a0}}\x{{3000}}]', ' ', 'g'), ' {{2,}}', ' ', 'g') AS line FROM documents")
def space_normalise(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", T.normalise_spaces(F.col("text")).alias("line"))


@query(f"WITH {sql.SCRIPTED}, {sql.language('line', 'doc_id, line_no')} SELECT doc_id, line_no, language FROM lang")
def language_vote(spark, sf):
    return views.lines(spark, sf, scripted=True).select("doc_id", "line_no", T.language(F.col("line")).alias("language"))


@query(rf"WITH {sql.SCRIPTED} SELECT doc_id, line_no, CASE WHEN line = '' THEN 0 ELSE len(regexp_extract_all(line, '{T.UNSPACED}')) + len(list_filter(string_split_regex(regexp_replace(line, '{T.UNSPACED}', ' ', 'g'), '{SPACE}+'), lambda w: w <> '')) END AS words, coalesce(len(regexp_extract_all(line, '{T.UNSPACED}')) / nullif(length(regexp_replace(line, '{SPACE}', '', 'g')), 0) > 0.5, false) AS unspaced FROM lines")
def word_count(spark, sf):
    return views.lines(spark, sf, scripted=True).select("doc_id", "line_no", T.word_count(F.col("line")).cast("long").alias("words"), T.mainly_unspaced(F.col("line")).alias("unspaced"))


@query(f"WITH {sql.WORDS}, z AS (SELECT doc_id, word_no, {sql.bare('word')} AS z FROM words) SELECT doc_id, word_no, {sql.NOISE} AS noise FROM z")
def noise_flag(spark, sf):
    return views.words(spark, sf).select("doc_id", "word_no", T.is_noise(F.col("word")).alias("noise"))


FEATURES_SQL = rf"""t AS (SELECT doc_id, line_no, line, regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') AS s FROM lines),
f AS (SELECT doc_id, line_no, length(line) AS text_length, len(regexp_extract_all(line, chr(10))) + 1 AS line_count, s <> '' AND regexp_matches(s, '[。！？.!?…~]$') AS ends_sentence,
CASE WHEN s = '' THEN 0 ELSE least(1.0, CASE WHEN regexp_matches(s, '^[A-Za-z\x{{4e00}}-\x{{9fff}}]{{1,6}}[:：]') THEN 0.6 ELSE 0 END + CASE WHEN regexp_matches(s, '^(?:——|──)') THEN 0.4 ELSE 0 END + CASE WHEN starts_with(s, '"') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(s, '^[「『]') THEN 0.3 ELSE 0 END) END AS dialogue,
CASE WHEN s = '' THEN 0 ELSE (len(regexp_extract_all(s, '\p{{Lu}}')) + 0.5 * len(regexp_extract_all(s, '[\p{{Nd}}\x{{b2}}\x{{b3}}\x{{b9}}]'))) / length(s) END AS proper_share,
s <> '' AND regexp_matches(s, '[¥￥$€£]{SPACE}*\p{{Nd}}+|\p{{Nd}}+{SPACE}*[元块]') AS price, s <> '' AND regexp_matches(s, '[省市区县镇乡村路街巷号弄楼层室栋]|(?i:Road|Street|Avenue|District|Building|Room)') AS address,
s <> '' AND (regexp_matches(s, '欢迎|禁止|请勿|注意|安全|消防|紧急|出口|入口') OR (length(s) >= 8 AND regexp_matches(s, '[！!]$'))) AS slogan FROM t)"""
SCORE_SQL = "greatest(-1.0, least(1.0, CASE WHEN dialogue > 0.5 THEN 0.4 ELSE 0 END + CASE WHEN ends_sentence AND text_length < 50 THEN 0.15 ELSE 0 END - CASE WHEN price THEN 0.3 ELSE 0 END - CASE WHEN address THEN 0.3 ELSE 0 END - CASE WHEN slogan THEN 0.2 ELSE 0 END - CASE WHEN proper_share > 0.3 THEN 0.2 ELSE 0 END))"


@query(f"WITH {sql.DRESSED}, {FEATURES_SQL} SELECT doc_id, line_no, text_length, line_count, ends_sentence, CAST(dialogue AS DOUBLE) AS dialogue, round(CAST(proper_share AS DOUBLE), 6) AS proper_share, price, address, slogan, round(CAST({SCORE_SQL} AS DOUBLE), 6) AS score FROM f")
def semantic_features(spark, sf):
    f = views.lines(spark, sf, dressed=True).select("doc_id", "line_no", T.semantic(F.col("line")).alias("f"))
    return f.select("doc_id", "line_no", F.col("f.text_length").cast("long").alias("text_length"), F.col("f.line_count").cast("long").alias("line_count"), "f.ends_sentence", "f.dialogue", F.round("f.proper_share", 6).alias("proper_share"), "f.price", "f.address", "f.slogan", F.round(T.semantic_score(F.col("f")), 6).alias("score"))


def _placed_sql(preset: str) -> str:
    _, (a, b, c, d), bias, *_ = classify.PRESETS[preset]
    return f"WITH {sql.DRESSED}, {FEATURES_SQL}, p AS (SELECT *, (doc_id % 20) / 20.0 AS rel_y, (line_no % 10) / 100.0 AS rel_height, line_no % 3 = 0 AS edge, {SCORE_SQL} AS semantic FROM f), q AS (SELECT *, greatest(-1.0, least(1.0, CASE WHEN rel_y > 0.80 THEN 0.6 WHEN rel_y < 0.15 THEN 0.5 ELSE 0 END + CASE WHEN edge THEN 0.2 ELSE 0 END - CASE WHEN rel_y > 0.25 AND rel_y < 0.70 THEN 0.3 ELSE 0 END - CASE WHEN rel_height < 0.02 THEN 0.2 ELSE 0 END)) AS spatial FROM p), r AS (SELECT *, round(greatest(0, least(1, ({a} * spatial + {b} * 0.5 + {c} * -0.2 + {d} * semantic + {bias} + 1) / 2)), 6) AS s FROM q), l AS (SELECT *, CASE WHEN s > 0.65 THEN 'overlay' WHEN s < 0.35 THEN 'scene' ELSE 'unknown' END AS label FROM r)"


def _placed(spark, sf):
    return views.lines(spark, sf, dressed=True).select("doc_id", "line_no", F.col("line").alias("text"), ((F.col("doc_id") % 20) / 20.0).alias("rel_y"), ((F.col("line_no") % 10) / 100.0).alias("rel_height"), (F.col("line_no") % 3 == 0).alias("edge"))


@query(_placed_sql("news") + " SELECT doc_id, line_no, label, CAST(CASE WHEN s > 0.65 THEN s WHEN s < 0.35 THEN 1 - s ELSE 0.5 END AS DOUBLE) AS confidence FROM l")
def source_class(spark, sf):
    return classify.classify(_placed(spark, sf), "news").select("doc_id", "line_no", "label", F.round("confidence", 6).alias("confidence"))


@query(_placed_sql("film_tv") + " SELECT doc_id, line_no, label FROM l WHERE label = 'overlay'")
def source_filter(spark, sf):
    return classify.keep(classify.classify(_placed(spark, sf), "film_tv"), "film_tv").select("doc_id", "line_no", "label")


@query(_placed_sql("news") + " SELECT label, count(*) AS n, count(*) FILTER (label = 'scene') AS kept FROM l GROUP BY 1")
def source_counters(spark, sf):
    return classify.counters(classify.classify(_placed(spark, sf), "news"), "surveillance")


@query(f"WITH {SUBS}, c AS (SELECT roi, seq, {sql.canonical('body')} AS a FROM subs), p AS (SELECT roi, seq, a, lag(a) OVER (PARTITION BY roi ORDER BY seq) AS b FROM c), {sql.common('p')} SELECT roi, seq, round(CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * coalesce(n, 0) / (length(a) + length(b)) END, 6) AS ratio FROM p LEFT JOIN lc USING (roi, seq) WHERE b IS NOT NULL")
def indel_ratio(spark, sf):
    """Every event against the one before."""
    return _ratios(views.subtitles(spark, sf).select("roi", "seq", T.canonical(F.col("body")).alias("a")))


def _ratios(canon: DataFrame) -> DataFrame:
    w = W.partitionBy("roi").orderBy("seq")
    s = canon.withColumn("b", F.lag("a").over(w)).where("b is not null")
    return s.select("roi", "seq", F.round(T.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(f"WITH {SUBS}, c AS (SELECT roi, seq, {sql.canonical('body')} AS a FROM subs), p AS (SELECT roi, seq, a, lag(a) OVER (PARTITION BY roi ORDER BY seq) AS b FROM c), {sql.common('p', sql.NEEDED)} SELECT roi, seq, {sql.SIMILAR} AS similar FROM p LEFT JOIN lc USING (roi, seq) WHERE b IS NOT NULL")
def similar_pairs(spark, sf):
    e = views.subtitles(spark, sf).select("roi", "seq", T.canonical(F.col("body")).alias("a"))
    p = e.withColumn("b", F.lag("a").over(W.partitionBy("roi").orderBy("seq"))).where("b is not null")
    return p.select("roi", "seq", T.bodies_similar(F.col("b"), F.col("a")).alias("similar"))


CLOSE_TIMED = f"{SUBS}, near AS (SELECT * EXCLUDE (start_sec, end_sec), start_sec * CAST(0.85 AS DOUBLE) AS start_sec, start_sec * CAST(0.85 AS DOUBLE) + 2.0 AS end_sec FROM subs), timed AS (SELECT *, {sql.seconds_text('start_sec')} AS start_time, {sql.seconds_text('end_sec')} AS end_time FROM near)"
SUBS_TIMED = f"{SUBS}, timed AS (SELECT *, {sql.seconds_text('start_sec')} AS start_time, {sql.seconds_text('end_sec')} AS end_time FROM subs)"


@query(f"WITH {SUBS_TIMED}, {sql.merged('timed')} SELECT roi, island, start_sec, end_sec, style, tags, body, n FROM done")
def neighbour_merge(spark, sf):
    return merge.merge_neighbours(views.subtitles(spark, sf))


FRAGMENTS_SQL = f"WITH RECURSIVE {CLOSE_TIMED}, z AS (SELECT *, {sql.parsed('start_time')} AS ts, {sql.parsed('end_time')} AS te, {sql.bare('body')} AS z FROM timed), r AS (SELECT *, {sql.NOISE} AS noise, row_number() OVER (PARTITION BY roi ORDER BY ts, seq) AS rn FROM z), w AS (SELECT roi, rn, seq, te, style, px, py, seq AS grp, px AS gx, py AS gy FROM r WHERE rn = 1 UNION ALL SELECT roi, rn, seq, te, style, px, py, CASE WHEN joins THEN o_grp ELSE seq END, CASE WHEN joins THEN o_gx ELSE px END, CASE WHEN joins THEN o_gy ELSE py END FROM (SELECT r.*, w.grp AS o_grp, w.gx AS o_gx, w.gy AS o_gy, r.style = 'Scene' AND w.style = 'Scene' AND NOT r.noise AND abs(r.px - w.gx) <= 24 AND abs(r.py - w.gy) <= 24 AND r.ts - w.te BETWEEN CAST(-0.12 AS DOUBLE) AND CAST(0.35 AS DOUBLE) AS joins FROM w JOIN r ON r.roi = w.roi AND r.rn = w.rn + 1))"


@query(FRAGMENTS_SQL + " SELECT roi, seq, grp FROM w")
def fragment_groups(spark, sf):
    return merge.fragment_groups(views.fragments(spark, sf)).select("roi", "seq", "grp")


def _obliging(prompt: str) -> str:
    """A client that does a little to each line."""
    return json.dumps({"lines": [{"id": r["id"], "text": r["text"] + " ok"} for r in json.loads(prompt)["lines"]]})


@query(rf"WITH {SUBS} SELECT roi, seq, regexp_replace(regexp_replace(body, '\\[nrt]|\r\n|[\r\n\t\x{{a0}}\x{{3000}}]', ' ', 'g') || ' ok', ' {{2,}}', ' ', 'g') AS body FROM subs")
def polished_events(spark, sf):
    return polish.polish(views.subtitles(spark, sf).select("roi", "seq", "body"), _obliging)


def _longest(prompt: str) -> str:
    """A client that takes the longest candidate."""
    return json.dumps({"text": max(json.loads(prompt)["candidates"], key=len) + " !"})


MERGED_SQL = rf""", m AS (SELECT w.roi, grp AS seq, near.start_sec, near.end_sec, style, near.seq AS own, body, regexp_full_match(body, '{SPACE}*') AS blank FROM w JOIN near USING (roi, seq, style)),
g AS (SELECT roi, seq, arg_min(start_sec, own) AS start_sec, arg_max(end_sec, own) AS end_sec, arg_min(style, own) AS style, list(body ORDER BY start_sec, own) AS bodies, list(body ORDER BY start_sec, own) FILTER (NOT blank) AS said FROM m GROUP BY 1, 2)
SELECT roi, seq, start_sec, end_sec, style, CASE WHEN len(bodies) = 1 THEN bodies[1] WHEN coalesce(len(said), 0) = 0 THEN list_reduce(bodies, lambda a, b: CASE WHEN length(trim(b)) > length(trim(a)) THEN b ELSE a END) WHEN len(said) = 1 THEN said[1]
ELSE regexp_replace(regexp_replace(list_reduce(said, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) || ' !', '\\[nrt]|\r\n|[\r\n\t\x{{a0}}\x{{3000}}]', ' ', 'g'), ' {{2,}}', ' ', 'g') END AS body FROM g"""


@query(FRAGMENTS_SQL + MERGED_SQL)
def merged_fragments(spark, sf):
    return merge.merge_fragments(views.fragments(spark, sf), _longest).select("roi", "seq", "start_sec", "end_sec", "style", "body")


@query(f"WITH {SUBS_TIMED}, r AS (SELECT *, row_number() OVER (ORDER BY CAST(roi AS VARCHAR), start_time, seq) - 1 AS k, count(*) OVER () AS n FROM timed) SELECT CASE WHEN k < 35 THEN k ELSE k - n + 70 END AS at, roi, seq, start_time, end_time, style, substring(body, 1, 220) AS text, CASE WHEN k = 34 THEN n - 70 END AS left_out FROM r WHERE k < 35 OR k >= n - 35")
def compacted_events(spark, sf):
    """The picture of all events that a client gets to see."""
    e = views.subtitles(spark, sf)
    timed = e.withColumns({"start_time": timefmt.from_seconds(F.col("start_sec")), "end_time": timefmt.from_seconds(F.col("end_sec"))})
    return polish.compact(timed)


@query(f"WITH {SUBS}, c AS (SELECT roi % 50 AS grp, roi * 1000 + seq AS seq, body, {sql.canonical('body')} AS canon FROM subs), v AS (SELECT grp, canon, count(*) AS votes FROM c GROUP BY 1, 2), b AS (SELECT grp, canon FROM v QUALIFY row_number() OVER (PARTITION BY grp ORDER BY votes DESC, length(canon) DESC, canon) = 1) SELECT grp, body FROM c JOIN b USING (grp, canon) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY length(body) DESC, seq) = 1")
def majority_body(spark, sf):
    return _majority(views.subtitles(spark, sf))


def _majority(events: DataFrame) -> DataFrame:
    c = events.select((F.col("roi") % 50).alias("grp"), (F.col("roi") * 1000 + F.col("seq")).alias("seq"), "body", T.canonical(F.col("body")).alias("canon"))
    v = c.groupBy("grp", "canon").agg(F.count(F.lit(1)).alias("votes"), F.max(F.struct(F.length("body").alias("n"), (-F.col("seq")).alias("s"), "body"))["body"].alias("body"))
    return v.groupBy("grp").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.length("canon")).alias("l"), "canon", "body"))["body"].alias("body"))


@query(f"WITH {EV}, d AS (SELECT roi, frame, time_sec, time_sec - lag(time_sec) OVER (PARTITION BY roi ORDER BY time_sec) AS step FROM ev WHERE time_sec > 0) SELECT roi, arg_min(time_sec, frame) AS start_sec, max(time_sec) + coalesce(list_sort(list(step) FILTER (step > 0))[CAST(floor(count(step) FILTER (step > 0) / 2) AS INT) + 1], 0.04) AS end_sec FROM d GROUP BY roi")
def end_time_estimate(spark, sf):
    return profile.end_times(views.observations(spark, sf), ["roi"], 25.0)


PROFILE_SQL = f"WITH {GROUPS}, {sql.PROFILE}"


@query(PROFILE_SQL + " SELECT roi, usual AS location, text_height FROM pr")
def roi_profile(spark, sf):
    return profile.profiles(views.groups(spark, sf))


@query(PROFILE_SQL + f", {sql.KEPT} SELECT roi, group_id, y, height, location FROM kept")
def profile_filter(spark, sf):
    return profile.drop_outliers(views.groups(spark, sf))


@query(rf"""WITH {sql.FRAMES}, cy AS (SELECT roi, frame, ls, (roi * 7 + frame) % 100 AS cy FROM f), lines AS (SELECT roi, frame, array_to_string(list_transform(ls, lambda l: l.text), ' ') AS txt FROM cy), {sql.language('txt', 'roi, frame')}
SELECT roi, frame, 0 AS k, CASE WHEN cy < 15 THEN 'Top' WHEN language = 'EN' THEN 'Default' ELSE language END AS style, CASE WHEN cy < 15 THEN '{{\an8}}' ELSE '' END AS tags, array_to_string(list_transform(ls, lambda l: l.text), '\n') AS body FROM cy JOIN lang USING (roi, frame) WHERE cy > 75 OR cy < 15
UNION ALL SELECT roi, frame, CAST(k - 1 AS INT), 'Scene', '{{\an5\pos(' || CAST(trunc(ls[k].x) AS INT) || ',' || CAST(trunc(ls[k].y) AS INT) || ')}}', ls[k].text FROM cy, unnest(generate_series(1, len(ls))) AS u(k) WHERE cy BETWEEN 15 AND 75""")
def style_position(spark, sf):
    rows = segment.frames(segment.readable(views.track(spark, sf)))
    y = ((F.col("roi") * 7 + F.col("frame")) % 100).cast("int")
    return rows.select("roi", "frame", F.posexplode(profile.style(F.col("lines"), y, F.lit(100))).alias("k", "e")).select("roi", "frame", "k", "e.*")


TIME_SQL = "printf('%d:%02d:%02d.%02d', CAST(floor({s} / 3600) AS BIGINT), CAST(floor((floor({s}) % 3600) / 60) AS BIGINT), CAST(floor({s}) % 60 AS BIGINT), CAST({c} AS BIGINT))"


@query("WITH t AS (SELECT o_orderkey, o_totalprice / 7 AS s, o_orderkey / 23.976 AS g FROM orders) SELECT o_orderkey, " + TIME_SQL.format(s="s", c="least(round_even((s - floor(s)) * 100, 0), 99)") + " AS by_seconds, " + TIME_SQL.format(s="g", c="floor((g - floor(g)) * 100)") + " AS by_frame FROM t")
def ass_time(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.select("o_orderkey", timefmt.from_seconds(F.col("o_totalprice") / 7).alias("by_seconds"), timefmt.from_frame(F.col("o_orderkey"), 23.976).alias("by_frame"))


@query("WITH t AS (SELECT o_orderkey, '0' || (o_orderkey % 10) || ':' || (o_orderkey % 60) || ':' || (o_orderkey % 59) || '.' || (o_orderkey % 100) AS s FROM orders) SELECT o_orderkey, CAST(string_split(s, ':')[1] AS INT) * 3600.0 + CAST(string_split(s, ':')[2] AS INT) * 60.0 + CAST(string_split(s, ':')[3] AS DOUBLE) AS sec, o_orderkey % 10 * 3600.0 + o_orderkey % 60 * 60.0 + o_orderkey % 59 + o_orderkey % 100 / 1000.0 AS roi_sec FROM t")
def ass_parse(spark, sf):
    k = F.col("o_orderkey")
    s = F.concat(F.lit("0"), k % 10, F.lit(":"), k % 60, F.lit(":"), k % 59, F.lit("."), k % 100)
    return views.table(spark, sf, "orders").select("o_orderkey", timefmt.to_seconds(s).alias("sec"), timefmt.roi_seconds(s).alias("roi_sec"))


@query(f"WITH {EV}, b AS (SELECT roi, seq, time_sec % 36000 AS s, time_sec % 36000 + 2 AS e, text FROM ev) SELECT seq, " + TIME_SQL.format(s="s", c="least(round_even((s - floor(s)) * 100, 0), 99)") + " AS start, 'Dialogue: 0,' || " + TIME_SQL.format(s="s", c="least(round_even((s - floor(s)) * 100, 0), 99)") + " || ',' || " + TIME_SQL.format(s="e", c="least(round_even((e - floor(e)) * 100, 0), 99)") + " || ',Default,,0,0,0,,' || text AS line FROM b")
def ass_lines(spark, sf):
    e = views.observations(spark, sf).select("seq", (F.col("time_sec") % 36000).alias("start_sec"), (F.col("time_sec") % 36000 + 2).alias("end_sec"), F.lit("Default").alias("style"), F.lit("").alias("tags"), F.col("text").alias("body"))
    return writers.event_lines(e).select("seq", "start", "line")


@query(f"WITH {EV}, s AS (SELECT roi, frame // 3 AS run, frame % 3 AS sample, 0 AS line_idx, text, score FROM ev), f AS (SELECT roi, run, min(sample) AS first FROM s GROUP BY 1, 2), v AS (SELECT roi, run, line_idx, text, count(*) AS n, avg(score) AS mean, min(sample) AS seen, arg_min(score, sample) AS score FROM s GROUP BY 1, 2, 3, 4) SELECT roi, run, line_idx, text, score FROM v QUALIFY row_number() OVER (PARTITION BY roi, run, line_idx ORDER BY n DESC, mean DESC, seen) = 1")
def positional_vote(spark, sf):
    o = views.observations(spark, sf)
    return vote.positional_vote(o.select("roi", F.floor(F.col("frame") / 3).alias("run"), (F.col("frame") % 3).alias("sample"), F.lit(0).alias("line_idx"), "text", "score"), ["roi", "run"])


@query("WITH n AS (SELECT user_id AS roi, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events), p AS (SELECT roi, frame, i, (roi * 7 + (frame // 3) * 13 * (i % 5) + i) % 256 AS v FROM n, unnest(generate_series(0, 63)) AS t(i)), d AS (SELECT roi, frame, abs(v - lag(v) OVER (PARTITION BY roi, i ORDER BY frame)) AS d FROM p) SELECT roi, frame, CASE WHEN count(d) > 0 THEN count(*) FILTER (d > 10) / 64.0::DOUBLE END AS changed FROM d GROUP BY 1, 2")
def motion_sentinel(spark, sf):
    return vote.changes(views.crops(spark, sf)).select("roi", "frame", "changed")


@query(f"WITH {EV} SELECT roi, frame, last_value(CASE WHEN score >= 0.6 THEN text END IGNORE NULLS) OVER (PARTITION BY roi ORDER BY frame ROWS UNBOUNDED PRECEDING) AS text FROM ev")
def forward_fill(spark, sf):
    o = views.observations(spark, sf).select("roi", "frame", F.when(F.col("score") >= 0.6, F.col("text")).alias("text"))
    return vote.fill_forward(o, ["roi"], ["frame"], "text")


@query("WITH v AS (SELECT p_partkey, p_size * 100 AS w, p_retailprice * 2 AS d, p_size / 20.0 AS a, p_size % 30 AS f FROM part) SELECT p_partkey, round(CAST(CASE WHEN w >= 3840 THEN 0.15 ELSE 0 END + CASE WHEN d > 3600 THEN 0.10 ELSE 0 END + CASE WHEN a > 2.0 THEN 0.25 ELSE 0 END + CASE WHEN f BETWEEN 23.9 AND 24.1 THEN 0.15 ELSE 0 END AS DOUBLE), 6) AS film_tv, round(CAST(CASE WHEN w < 3840 AND w <= 720 THEN 0.25 ELSE 0 END + CASE WHEN a > 1.3 AND a < 1.45 THEN 0.15 ELSE 0 END + CASE WHEN f < 15 THEN 0.20 ELSE 0 END AS DOUBLE), 6) AS surveillance, round(CAST(CASE WHEN d < 60 THEN 0.25 ELSE 0 END + CASE WHEN d >= 60 AND d < 300 THEN 0.10 ELSE 0 END + CASE WHEN a < 1.1 THEN 0.30 ELSE 0 END AS DOUBLE), 6) AS short_video FROM v")
def metadata_score(spark, sf):
    s = detect.metadata_scores(F.col("p_size") * 100, F.col("p_retailprice") * 2, F.col("p_size") / 20.0, F.col("p_size") % 30)
    return views.table(spark, sf, "part").select("p_partkey", *[F.round(s[k], 6).alias(k) for k in ("film_tv", "surveillance", "short_video")])


def _prototype_sql() -> str:
    rows = [f"SELECT vec_id AS video_id, '{p}' AS preset, 0.7 * exp(-sqrt((" + " + ".join(f"((abs(CAST(embedding[{i + 1}] AS DOUBLE)) - {m}) / {max(d, 0.01)}) ** 2" for i, (m, d) in enumerate(cells)) + f") / {len(cells)})) AS score FROM embeddings" for p, cells in detect.PROTOTYPES.items()]
    return "WITH s AS (" + " UNION ALL ".join(rows) + ") SELECT video_id, preset, round(score, 6) AS score, CAST(row_number() OVER w AS INT) AS rank, row_number() OVER w BETWEEN 2 AND 4 AND score > 0.85 * first_value(score) OVER w AS near FROM s WINDOW w AS (PARTITION BY video_id ORDER BY score DESC, preset)"


@query(_prototype_sql())
def prototype_rank(spark, sf):
    return detect.rank_prototypes(views.features(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {EV}, e AS (SELECT roi, frame, score >= 0.6 AS has, lag(score >= 0.6) OVER (PARTITION BY roi ORDER BY frame) AS was, min(frame) OVER (PARTITION BY roi) AS a, max(frame) OVER (PARTITION BY roi) AS z FROM ev) SELECT roi, frame, greatest(frame - 3, a) AS lo, least(frame + 2, z) AS hi FROM e WHERE was IS NOT NULL AND was <> has")
def edge_windows(spark, sf):
    return refine.edges(views.observations(spark, sf).select("roi", "frame", (F.col("score") >= 0.6).alias("has")), 3, 2)


@query(f"WITH {EV}, n AS (SELECT roi, frame, upper(text) AS t FROM ev WHERE score < 0.5) SELECT roi, frame, coalesce(t, text) AS text FROM ev LEFT JOIN n USING (roi, frame)")
def upsert_results(spark, sf):
    o = views.observations(spark, sf)
    return refine.upsert(o.select("roi", "frame", "text"), o.where("score < 0.5").select("roi", "frame", F.upper("text").alias("text")), ["roi", "frame"], "text")


@query("SELECT o_custkey AS k, 'extra' AS side FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000 EXCEPT SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT c_custkey, 'missing' FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000)")
def key_diff(spark, sf):
    a = views.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return refine.key_difference(a, views.table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")), "k")


@query(f"WITH {EV} SELECT roi, CAST(floor(CASE WHEN time_sec > 0 THEN time_sec ELSE frame / 25.0 END / 86400) AS BIGINT) AS slice, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM ev GROUP BY 1, 2")
def time_slices(spark, sf):
    return slices.slices(views.observations(spark, sf), 86400.0)


@query("SELECT p_partkey, p_partkey % 50 - 10 + p_size AS x1, p_partkey % 30 - 5 + p_size AS y1, p_partkey % 50 - 10 + 2 * p_size AS x2, p_partkey % 30 - 5 + 3 * p_size AS y2 FROM part")
def coordinate_restore(spark, sf):
    k, s = F.col("p_partkey").cast("int"), F.col("p_size")
    p = views.table(spark, sf, "part").withColumn("o", geometry.offset(F.lit("rect"), F.format_string("[%d,%d,9,9]", k % 50 - 10, k % 30 - 5), F.lit(False)))
    b = geometry.shift_boxes(F.array(F.array(s, s, 2 * s, 3 * s)), F.col("o.dx"), F.col("o.dy"))
    return p.select("p_partkey", *[F.get(F.get(b, F.lit(0)), F.lit(i)).cast("long").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT p_partkey, CASE WHEN least(p_partkey % 60 - 20 + p_size, 50) > greatest(p_partkey % 60 - 20, 0) AND least(p_partkey % 40 - 20 + p_size, 30) > greatest(p_partkey % 40 - 20, 0) THEN (least(p_partkey % 60 - 20 + p_size, 50) - greatest(p_partkey % 60 - 20, 0)) * (least(p_partkey % 40 - 20 + p_size, 30) - greatest(p_partkey % 40 - 20, 0)) END AS area FROM part")
def crop_bounds(spark, sf):
    k = F.col("p_partkey")
    c = geometry.crop(k % 60 - 20, k % 40 - 20, F.col("p_size"), F.col("p_size"), F.lit(50), F.lit(30))
    return views.table(spark, sf, "part").select("p_partkey", c.alias("c")).select("p_partkey", ((F.col("c.x2") - F.col("c.x1")) * (F.col("c.y2") - F.col("c.y1"))).alias("area"))


@query(f"WITH RECURSIVE {sql.EVENTS} SELECT roi, island AS seq, start_sec, end_sec, start_time, end_time, style, tags, body FROM done")
def subtitle_events(spark, sf):
    return subtitles.events(views.track(spark, sf))


@query(f"WITH RECURSIVE {sql.EVENTS} SELECT 'v' || (roi % 2) AS video, roi // 2 AS roi, island AS seq, start_time AS start, 'Dialogue: 0,' || start_time || ',' || end_time || ',' || style || ',,0,0,0,,' || tags || body AS line FROM done")
def subtitle_file(spark, sf):
    """Two videos, whose regions have the same ids."""
    track = views.track(spark, sf)
    return subtitles.dialogue(track.withColumns({"video": F.concat(F.lit("v"), F.col("roi") % 2), "roi": F.floor(F.col("roi") / 2)}))


@query(f"WITH {sql.BOXES}, c AS (SELECT grp, least(4, CAST(floor((x1 + x2) / 2.0 / 640 * 5) AS INT)) AS gx, least(4, CAST(floor((y1 + y2) / 2.0 / 360 * 5) AS INT)) AS gy, count(*) AS n FROM boxes GROUP BY 1, 2, 3), p AS (SELECT grp, n / sum(n) OVER (PARTITION BY grp) AS p FROM c) SELECT grp, round(-sum(p * log2(p + 1e-10)) / log2(25), 6) AS entropy FROM p GROUP BY grp")
def location_entropy(spark, sf):
    e = detect.location_entropy(views.boxes(spark, sf), ["grp"], F.lit(640), F.lit(360))
    return e.withColumn("entropy", F.round("entropy", 6))


@query(f"WITH {sql.BOXES} SELECT key, round((y1 + y2) / 2.0 / 360, 6) AS rel_y, round((y2 - y1) / 360.0, 6) AS rel_height, x1 < 5 OR y1 < 5 OR x2 > 635 OR y2 > 355 AS edge, (y1 + y2) / 2.0 / 360 > 0.80 OR (y1 + y2) / 2.0 / 360 < 0.15 AS safe FROM boxes")
def spatial_features(spark, sf):
    f = classify.spatial_features(F.array("x1", "y1", "x2", "y2"), F.lit(640), F.lit(360))
    return views.boxes(spark, sf).select("key", F.round(f["rel_y"], 6).alias("rel_y"), F.round(f["rel_height"], 6).alias("rel_height"), f["edge"].alias("edge"), f["safe"].alias("safe"))


@query(f"WITH {sql.BOXES} SELECT key // 10 AS grp, avg(x1) AS x1, avg(y1) AS y1, avg(x2) AS x2, avg(y2) AS y2 FROM boxes GROUP BY 1")
def mean_box(spark, sf):
    """Of the boxes of each order."""
    own = views.boxes(spark, sf).groupBy(F.floor(F.col("key") / 10).alias("grp")).agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])).alias("b")).select("grp", profile.mean_box(F.col("b")).alias("m"))
    return own.select("grp", *[F.get("m", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])


@query(f"WITH {sql.FRAMES} SELECT roi, frame, {sql._MEDIAN} AS text_height, list_sum(list_transform(ls, lambda l: l.top + l.height / 2)) / len(ls) AS y FROM f")
def frame_heights(spark, sf):
    rows = segment.frames(segment.readable(views.track(spark, sf)))
    return rows.select("roi", "frame", profile.text_height(F.col("lines")).alias("text_height"), profile.centre_y(F.col("lines")).alias("y"))


@query(f"WITH {sql.FRAMES}, ft AS (SELECT roi, frame, trim(array_to_string(list_transform(ls, lambda l: l.text), '')) AS t FROM f), fp2 AS (SELECT *, lag(t) OVER (PARTITION BY roi ORDER BY frame) AS p FROM ft) SELECT roi, frame, t <> '' AND t = p AS same, t <> '' AS present FROM fp2 WHERE p IS NOT NULL")
def same_text(spark, sf):
    texts = F.transform(segment.by_top(F.col("lines")), lambda m: m["text"])
    rows = segment.frames(segment.readable(views.track(spark, sf))).select("roi", "frame", texts.alias("t"))
    p = rows.withColumn("p", F.lag("t").over(W.partitionBy("roi").orderBy("frame"))).where("p is not null")
    return p.select("roi", "frame", segment.texts_equal(F.col("t"), F.col("p")).alias("same"), segment.text_present(F.col("t")).alias("present"))


@query(f"WITH {sql.RATIOS} SELECT video_id, frame, bool_or(ratio >= 0.2) AS passed, greatest(max(ratio), 0.0) AS max_ratio FROM ratios GROUP BY 1, 2")
def gate_frames(spark, sf):
    return gate.frames_passing(views.ratios(spark, sf), 0.2)


@query(f"WITH {sql.RATIOS}, f AS (SELECT video_id, frame, max(ratio) AS r FROM ratios GROUP BY 1, 2) SELECT video_id, count(*) FILTER (r >= 0.2) AS kept, count(*) AS sampled, count(*) FILTER (r >= 0.2) / count(*) AS keep_ratio, 977 AS planned, greatest(1, CAST(round_even(977 * (count(*) FILTER (r >= 0.2) / count(*)), 0) AS BIGINT)) AS estimated, count(*) FILTER (r >= 0.35) AS other FROM f GROUP BY 1")
def gate_statistics(spark, sf):
    seen = gate.frames_passing(views.ratios(spark, sf), 0.2)
    planned = seen.select("video_id", F.lit(977).alias("planned")).distinct()
    return gate.statistics(seen, planned).join(gate.recount(seen, 0.35).withColumnRenamed("kept", "other"), "video_id")


@query(f"WITH {ROIS}, r AS (SELECT kind AS video_id, key % 40 AS n, least(s, e) AS s, greatest(s, e) AS e FROM rois), a AS (SELECT DISTINCT kind AS video_id, f AS frame FROM rois, (SELECT unnest(generate_series(0, 2500, 100)) AS f)) SELECT a.video_id, CAST(frame AS INT) AS frame, CAST(coalesce(min(n) FILTER (frame BETWEEN s AND e), -1) AS INT) AS position FROM a LEFT JOIN r USING (video_id) GROUP BY 1, 2")
def calibration_region(spark, sf):
    r = intervals.clamp(views.intervals(spark, sf), 1_000_000).select(F.col("kind").alias("video_id"), F.concat(F.lit("roi_"), F.col("key") % 40).alias("roi_id"), "start", "end")
    at = r.select("video_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(2500), F.lit(100))))
    return gate.calibration_region(r, at)


def _keyword_sql(name: str) -> dict[str, str]:
    return {k: f"{detect.HIT} * (" + " + ".join(f"CAST(contains(lower({name}), '{w.lower()}') AS INT)" for w in words) + ")" for k, words in detect.KEYWORDS.items()}


def _name_sql(column: str) -> str:
    return f"[{', '.join(f"'{n}'" for n in views.NAMES)}][CAST({column} % {len(views.NAMES)} + 1 AS INT)]"


@query(f"SELECT vec_id AS video_id, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in _keyword_sql(_name_sql("vec_id")).items()) + " FROM embeddings")
def keyword_scores(spark, sf):
    found = detect.keyword_scores(F.col("file_name"))
    return views.videos(spark, sf).select("video_id", *[F.round(c, 6).alias(k) for k, c in found.items()])


def _detect_sql() -> str:
    fix = {"motion_intensity": (0.01, 0.1), "scene_cut_frequency": (0.0, 0.2), "static_ratio": (0.9, 0.3), "color_histogram_spread": (0.1, 0.5), "letterbox_ratio": (0.0, 0.2), "text_density": (0.0, 0.01), "multi_font_score": (0.0, 0.0)}
    own = {f: f"abs(CAST(embedding[{i + 1}] AS DOUBLE))" for i, f in enumerate(detect.FEATURES)} | {"color_histogram_spread": "0.6"}
    own = {f: f"CASE vec_id % 10 WHEN 3 THEN {fix[f][0]} WHEN 6 THEN {fix[f][1]} ELSE {v} END" if f in fix else v for f, v in own.items()}
    v = f"v AS (SELECT vec_id AS video_id, {_name_sql('vec_id')} AS file_name, vec_id % 9 * 600 AS width, vec_id % 100 * 50.0 AS duration, CAST(0.9 AS DOUBLE) + vec_id % 14 * CAST(0.1 AS DOUBLE) AS aspect, 10.0 + vec_id % 20 AS fps, {', '.join(f'CAST({x} AS DOUBLE) AS {f}' for f, x in own.items())} FROM embeddings)"
    when = lambda c, x: f"CASE WHEN {c} THEN {x} ELSE 0 END"
    meta = {
        "film_tv": [("width >= 3840", 0.15), ("duration > 3600", 0.10), ("aspect > 2.0", 0.25), ("fps BETWEEN 23.9 AND 24.1", 0.15)], "documentary": [("width >= 3840", 0.10)], "surveillance": [("width <= 720", 0.25), ("aspect > 1.3 AND aspect < 1.45", 0.15), ("fps < 15", 0.20)],
        "live_stream": [("width <= 720", 0.05), ("aspect < 1.1", 0.20)], "conference": [("duration > 3600", 0.15)], "education": [("duration > 3600", 0.10), ("aspect > 1.3 AND aspect < 1.45", 0.10)], "short_video": [("duration < 60", 0.25), ("duration >= 60 AND duration < 300", 0.10), ("aspect < 1.1", 0.30)], "news": [("duration >= 60 AND duration < 300", 0.05)], "anime": [("fps BETWEEN 23.9 AND 24.1", 0.10)],
    }
    names = _keyword_sql("file_name")
    rows = []
    for at, (p, cells) in enumerate(detect.PROTOTYPES.items()):
        near = f"exp(-sqrt(({' + '.join(f'(({f} - {m}) / {max(d, 0.01)}) ** 2' for f, (m, d) in zip(detect.FEATURES, cells))}) / {len(cells)}))"
        rows.append(f"SELECT video_id, '{p}' AS preset, {at} AS o, 0.7 * {near} + 0.3 * ({' + '.join([*[when(c, x) for c, x in meta.get(p, [])], names[p]])}) AS score FROM v")
    strong = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(file_name), '{w}')" for w in words)} THEN {{'p': '{p}', 'c': CAST({c} AS DOUBLE)}}" for words, p, c in detect.STRONG) + " END"
    rule = """CASE WHEN motion_intensity < 0.02 AND scene_cut_frequency < 0.02 AND static_ratio > 0.80 AND color_histogram_spread < 0.25 THEN {'p': 'surveillance', 'c': 0.90::DOUBLE}
WHEN multi_font_score > 0.65 AND scene_cut_frequency > 0.25 AND color_histogram_spread > 0.50 THEN {'p': 'variety_show', 'c': 0.85::DOUBLE}
WHEN motion_intensity > 0.20 AND scene_cut_frequency < 0.10 AND letterbox_ratio < 0.02 AND static_ratio < 0.15 THEN {'p': 'gameplay', 'c': 0.82::DOUBLE}
WHEN text_density > 0.10 AND static_ratio > 0.50 AND motion_intensity > 0.02 AND motion_intensity < 0.12 THEN {'p': 'education', 'c': 0.82::DOUBLE}
WHEN letterbox_ratio > 0.03 AND aspect > 1.7 AND motion_intensity > 0.05 AND motion_intensity < 0.30 THEN {'p': 'film_tv', 'c': 0.85::DOUBLE}
WHEN static_ratio < 0.12 AND scene_cut_frequency < 0.05 AND fps >= 25 AND text_location_entropy > 0.40 THEN {'p': 'live_stream', 'c': 0.80::DOUBLE} END"""
    return f"""WITH {v}, s AS ({' UNION ALL '.join(rows)}), k AS (SELECT video_id, list({{'p': preset, 's': score}} ORDER BY score DESC, o) AS ps FROM s GROUP BY video_id),
n AS (SELECT video_id, {strong} AS n, {rule} AS r FROM v), m AS (SELECT video_id, ps, CASE WHEN n.c >= 0.90 THEN n END AS n, CASE WHEN r.c >= 0.85 THEN r END AS r FROM n JOIN k USING (video_id))
SELECT video_id, coalesce(n.p, r.p, ps[1].p) AS preset, round(coalesce(n.c, r.c, ps[1].s), 6) AS confidence, CASE WHEN n IS NOT NULL THEN 'name' WHEN r IS NOT NULL THEN 'rule' ELSE 'prototype' END AS layer,
CASE WHEN n IS NOT NULL THEN '' WHEN r IS NOT NULL THEN CASE r.p WHEN 'surveillance' THEN 'conference' WHEN 'variety_show' THEN 'short_video' ELSE 'documentary' END ELSE array_to_string(list_transform(list_filter(ps[2:4], lambda x: x.s > ps[1].s * 0.85), lambda x: x.p), ',') END AS alternatives FROM m"""


@query(_detect_sql())
def video_detect(spark, sf):
    return detect.detect(views.videos(spark, sf)).withColumns({"confidence": F.round("confidence", 6), "alternatives": F.array_join("alternatives", ",")})


@query("""WITH v AS (SELECT o_orderkey, o_orderkey * 7 % 30000 + 1 AS n, o_custkey % 5000 AS a, o_custkey % 5000 + 100 AS b FROM orders), w AS (SELECT *, greatest(1, CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT)) AS h, CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) AS t FROM v),
l AS (SELECT o_orderkey, CASE WHEN n <= 300 THEN range(0, n, greatest(1, n // 20)) ELSE list_sort(list_distinct(list_concat([0, h // 2, h, t, t + (n - t) // 2, n - 1, a, (a + b) // 2, b], CASE WHEN t > h THEN range(h, t, greatest(1, (t - h) // greatest(15, least(20, n // 500)))) ELSE [] END)))[1:30] END AS fs FROM w) SELECT o_orderkey, array_to_string(fs, ',') AS frames FROM l""")
def sample_list(spark, sf):
    o = views.table(spark, sf, "orders")
    roi = F.array(F.struct((F.col("o_custkey") % 5000).alias("start"), (F.col("o_custkey") % 5000 + 100).alias("end")))
    return o.select("o_orderkey", F.array_join(detect.sample_list(F.col("o_orderkey") * 7 % 30000 + 1, roi), ",").alias("frames"))


VISUAL_SQL = "WITH f AS (SELECT p_partkey, p_size % 2 = 0 AS a, p_size % 3 = 0 AS b, p_size % 5 = 0 AS c, p_size / 50.0 AS d, p_partkey % 10 / 10.0 AS e, p_partkey % 7 / 10.0 AS g, p_partkey % 11 / 20.0 AS h FROM part) SELECT p_partkey, round(CAST(greatest(-1.0, least(1.0, CASE WHEN a THEN 0.35 ELSE 0 END + CASE WHEN b THEN 0.25 ELSE 0 END + CASE WHEN c THEN 0.3 ELSE 0 END + CASE WHEN d > 0.7 THEN 0.2 ELSE 0 END - CASE WHEN e > 0.3 THEN 0.4 ELSE 0 END - CASE WHEN g < 0.3 THEN 0.2 ELSE 0 END - CASE WHEN h > 0.4 THEN 0.15 ELSE 0 END)) AS DOUBLE), 6) AS visual, round(CAST(greatest(-1.0, least(1.0, CASE WHEN d * 50 > 1 AND d * 50 < 8 THEN 0.3 ELSE 0 END - CASE WHEN d * 50 > 30 THEN 0.4 ELSE 0 END + CASE WHEN a THEN 0.2 ELSE 0 END + CASE WHEN g < 0.3 THEN 0.3 ELSE 0 END + CASE WHEN c THEN 0.2 ELSE 0 END)) AS DOUBLE), 6) AS temporal FROM f"


@query(VISUAL_SQL)
def layer_scores(spark, sf):
    s, k = F.col("p_size"), F.col("p_partkey")
    visual = classify.visual_score(s % 2 == 0, s % 3 == 0, s % 5 == 0, s / 50, k % 10 / 10, k % 7 / 10, k % 11 / 20)
    temporal = classify.temporal_score(s, s % 2 == 0, k % 7 / 10, s % 5 == 0)
    return views.table(spark, sf, "part").select("p_partkey", F.round(visual, 6).alias("visual"), F.round(temporal, 6).alias("temporal"))


@query("WITH t AS (SELECT o_orderkey, o_totalprice / 7 AS s, (o_orderkey % 100) || ':' || (o_orderkey % 60) || ':' || (o_orderkey % 59) || ',' || (o_orderkey % 1000) AS a, (o_orderkey % 60) || ':' || (o_orderkey % 59) || '.' || (o_orderkey % 10) AS b FROM orders) SELECT o_orderkey, printf('%02d:%02d:%02d.%03d', CAST(floor(s / 3600) AS BIGINT), CAST(floor((floor(s) % 3600) / 60) AS BIGINT), CAST(floor(s) % 60 AS BIGINT), CAST(floor((s - floor(s)) * 1000) AS BIGINT)) AS shown, o_orderkey % 100 * 3600.0::DOUBLE + o_orderkey % 60 * 60 + (o_orderkey % 59 + o_orderkey % 1000 / 1000.0::DOUBLE) AS three, o_orderkey % 60 * 60.0::DOUBLE + (o_orderkey % 59 + o_orderkey % 10 / 1000.0::DOUBLE) AS two, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE CAST(trunc((o_orderkey % 24 * 3600.0::DOUBLE + o_orderkey % 60 * 60.0 + o_orderkey % 59 + o_orderkey % 1000 / 1000.0::DOUBLE) * 23.976::DOUBLE) AS BIGINT) END AS frame FROM t")
def clock_texts(spark, sf):
    k = F.col("o_orderkey")
    three = F.concat(k % 100, F.lit(":"), k % 60, F.lit(":"), k % 59, F.lit(","), k % 1000)
    spoken = F.concat(k % 24, F.lit(":"), k % 60, F.lit(":"), k % 59, F.lit("."), k % 1000)
    two = F.concat(k % 60, F.lit(":"), k % 59, F.lit("."), k % 10)
    frame = timefmt.frame_number(F.when(k % 3 == 0, k), spoken, 23.976)
    return views.table(spark, sf, "orders").select("o_orderkey", timefmt.clock(F.col("o_totalprice") / 7).alias("shown"), timefmt.from_clock(three).alias("three"), timefmt.from_clock(two).alias("two"), frame.alias("frame"))


@query(f"WITH {ROIS}, g AS (SELECT key, least(s, e) * CAST(0.01 AS DOUBLE) AS a, greatest(s, e) * CAST(0.01 AS DOUBLE) AS b FROM rois WHERE s <> e), t AS (SELECT key, CASE WHEN b - CAST(0.03 AS DOUBLE) <= a + CAST(0.03 AS DOUBLE) THEN [(a + b) / 2] ELSE list_transform([0, 1, 2], lambda i: a + CAST(0.03 AS DOUBLE) + ((b - CAST(0.03 AS DOUBLE)) - (a + CAST(0.03 AS DOUBLE))) * i / 2) END AS ts FROM g) SELECT key, round(unnest(ts), 6) AS time_sec FROM t")
def segment_times(spark, sf):
    r = intervals.clamp(views.intervals(spark, sf), 1_000_000)
    s = r.select("key", (F.col("start") * 0.01).alias("start_sec"), (F.col("end") * 0.01).alias("end_sec"))
    return readers.segment_times(s, 3).select("key", F.round("time_sec", 6).alias("time_sec"))


def _raw(spark, sf):
    """Raw results of an engine for each order: a line for each of its items."""
    li = views.table(spark, sf, "lineitem")
    x, y = F.col("l_partkey") % 300 + 0.75, F.col("l_suppkey") % 200 + 0.25
    poly = F.array(F.array(x, y), F.array(x + F.col("l_quantity"), y), F.array(x + F.col("l_quantity"), y + 9.5), F.array(x, y + 9.5))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", poly.alias("poly"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.when(F.col("l_linenumber") % 4 == 3, 0.0).otherwise(F.col("l_discount") * 10).alias("score"))


def _record_rows(raw: DataFrame, rule: str) -> DataFrame:
    zipped = lambda r: F.arrays_zip(*[r[c].alias(c) for c in ("rec_texts", "rec_scores", "rec_boxes", "rec_polys")])
    z = raw.select("l_orderkey", F.posexplode(T.let(engines.normalised(F.col("raw"), rule), zipped)).alias("line_idx", "z"))
    return z.select("l_orderkey", "line_idx", F.col("z.rec_texts").alias("text"), F.round("z.rec_scores", 6).alias("score"), F.array_join(F.col("z.rec_boxes").cast("array<string>"), ",").alias("box"), F.size("z.rec_polys").alias("corners"))


ENGINE_SQL = "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 300 + 0.75 AS x, l_suppkey % 200 + 0.25 AS y, l_quantity AS w, l_returnflag || l_linestatus AS text, CASE WHEN l_linenumber % 4 = 3 THEN 0.0 ELSE l_discount * 10 END AS score FROM lineitem) SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, w) - 1 AS INT) AS line_idx, text, round(CAST({score} AS DOUBLE), 6) AS score, CAST(trunc(x) AS INT) || ',' || CAST(trunc(y) AS INT) || ',' || CAST(trunc(x + w) AS INT) || ',' || CAST(trunc(y + 9.5) AS INT) AS box, 4 AS corners FROM r {where}"


@query(ENGINE_SQL.format(score="CASE WHEN l_linenumber = 2 THEN 1.0 ELSE score END", where=""))
def engine_triples(spark, sf):
    parts = F.when(F.col("l_linenumber") == 2, F.concat_ws(",", F.to_json("poly"), F.to_json(F.array("text")).substr(F.lit(2), F.length("text") + 2))).otherwise(F.concat_ws(",", F.to_json("poly"), F.concat(F.lit('"'), "text", F.lit('"')), F.col("score").cast("string")))
    raw = _raw(spark, sf).withColumn("item", F.concat(F.lit("["), parts, F.lit("]"))).groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "item"))), lambda m: m["item"]), ","), F.lit("]")).alias("raw"))
    return _record_rows(raw, "triple")


@query(ENGINE_SQL.format(score="score", where=""))
def engine_documents(spark, sf):
    """Odd orders give a document of parallel arrays (scores longer than the rest), even ones give lines."""
    own = _raw(spark, sf).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "poly", "text", "score"))).alias("m"))
    get = lambda k: F.transform("m", lambda x: x[k])
    boxes = F.transform("m", lambda x: F.array(x["poly"][0][0], x["poly"][0][1], x["poly"][2][0], x["poly"][2][1]))
    doc = F.to_json(F.array(F.struct(get("text").alias("rec_texts"), F.concat(get("score"), F.array(F.lit(0.5))).alias("rec_scores"), get("poly").alias("rec_polys"), boxes.alias("rec_boxes"))))
    line = F.concat(F.lit("["), F.array_join(F.transform("m", lambda x: F.concat(F.lit("["), F.to_json(x["poly"]), F.lit(',["'), x["text"], F.lit('",'), x["score"].cast("string"), F.lit("]]"))), ","), F.lit("]"))
    return _record_rows(own.select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 1, doc).otherwise(line).alias("raw")), "document")


@query("WITH m AS (" + ENGINE_SQL.format(score="score", where="WHERE l_linenumber % 5 <> 4") + ") SELECT * FROM m")
def engine_mixed(spark, sf):
    """Lines as objects with flat boxes of 4 or 8 numbers, or as triples; every fifth is blank and goes."""
    c = lambda i, j: F.get(F.get("poly", F.lit(i)), F.lit(j)).cast("string")
    text = F.when(F.col("l_linenumber") % 5 == 4, F.lit(" ")).otherwise(F.col("text"))
    four, eight = F.concat_ws(",", c(0, 0), c(0, 1), c(2, 0), c(2, 1)), F.concat_ws(",", *[c(i, j) for i in range(4) for j in range(2)])
    obj = F.concat(F.lit('{"text":"'), text, F.lit('","'), F.when(F.col("l_linenumber") % 2 == 0, "confidence").otherwise("score"), F.lit('":'), F.col("score").cast("string"), F.lit(',"box":['), F.when(F.col("l_linenumber") % 2 == 0, four).otherwise(eight), F.lit("]}"))
    item = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("["), F.to_json("poly"), F.lit(',"'), text, F.lit('",'), F.col("score").cast("string"), F.lit("]"))).otherwise(obj)
    raw = _raw(spark, sf).withColumn("item", item).groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "item"))), lambda m: m["item"]), ","), F.lit("]")).alias("raw"))
    return _record_rows(raw, "mixed")


@query("WITH v AS (SELECT vec_id, ['film_tv', 'news', 'surveillance', 'nothing'][CAST(vec_id % 4 + 1 AS INT)] AS preset FROM embeddings) SELECT vec_id, preset, CASE preset WHEN 'film_tv' THEN false WHEN 'news' THEN true WHEN 'surveillance' THEN true END AS keep_scene, CASE preset WHEN 'film_tv' THEN 0.15 WHEN 'news' THEN 0.0 WHEN 'surveillance' THEN -0.25 END::DOUBLE AS bias FROM v")
def preset_lookup(spark, sf):
    v = views.table(spark, sf, "embeddings").select("vec_id", F.element_at(F.array(*map(F.lit, ("film_tv", "news", "surveillance", "nothing"))), (F.col("vec_id") % 4 + 1).cast("int")).alias("preset"))
    return classify.with_preset(v).select("vec_id", "preset", "keep_scene", "bias")


@query("SELECT c_custkey, md5('/videos/' || c_name || '.mp4') AS key FROM customer")
def settings_key(spark, sf):
    c = views.table(spark, sf, "customer")
    return c.select("c_custkey", writers.settings_key(F.concat(F.lit("/videos/"), F.col("c_name"), F.lit(".mp4"))).alias("key"))


@query("WITH r AS (SELECT l_orderkey AS frame_num, 'roi_' || (l_linenumber - 1) AS roi_id, l_linenumber <> 3 AS text, l_quantity AS q, l_linenumber AS n FROM lineitem), o AS (SELECT *, CASE n WHEN 1 THEN -5 WHEN 2 THEN 4 WHEN 3 THEN 0 WHEN 5 THEN 0 END AS dx, CASE n WHEN 1 THEN 7 WHEN 2 THEN 9 WHEN 3 THEN 0 WHEN 5 THEN 0 END AS dy FROM r) SELECT frame_num, roi_id, CASE WHEN text THEN q + dx ELSE q END AS x1, CASE WHEN text THEN q * 2 + dy ELSE q * 2 END AS y1, CAST(CASE WHEN text THEN 1 + dx ELSE 1.0 END AS DOUBLE) AS px FROM o WHERE NOT text OR dx IS NOT NULL")
def record_restore(spark, sf):
    """Rectangles, polygons, whole frames and regions without an offset; the third line of an order is without text."""
    q = F.col("l_quantity")
    r = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_num"), F.concat(F.lit("roi_"), F.col("l_linenumber") - 1).alias("roi_id"), F.when(F.col("l_linenumber") != 3, F.array(F.lit("t"))).otherwise(F.expr("cast(array() as array<string>)")).alias("rec_texts"), F.array(F.array(q, q * 2, q * 3, q * 4)).alias("rec_boxes"), F.array(F.array(F.array(F.lit(1.0), F.lit(2.0)))).alias("dt_polys"), F.array(F.array(F.array(F.lit(1.0), F.lit(2.0)))).alias("rec_polys"))
    offsets = [("roi_0", "rect", "[-5,7,9,9]", False), ("roi_1", "poly", "[[9,11],[4,12],[6,9]]", False), ("roi_2", "rect", "[1,1,1,1]", False), ("roi_3", "poly", "[[1,1]]", False), ("roi_4", "rect", None, True), ("roi_5", "odd", "[1,2,3,4]", None)]
    back = readers.restored(r, spark.createDataFrame(offsets, "roi_id string, type string, points string, full_frame boolean"))
    first = lambda c, *at: functools.reduce(lambda x, k: F.get(x, F.lit(k)), at, F.col(c))
    return back.select("frame_num", "roi_id", first("rec_boxes", 0, 0).alias("x1"), first("rec_boxes", 0, 1).alias("y1"), first("dt_polys", 0, 0, 0).alias("px"))
