"""Events: noise, neighbour merge by gaps and islands, fragments, majority bodies, upper medians."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphflow.functions import text as T
from glyphflow.functions import timefmt
from glyphflow.operators import fold
from glyphflow.operators.segment import track_of

MAX_GAP, OVERLAP_SEC, NEAR_PX, RATIO = 4.0, -0.12, 24, 0.78
FRAGMENT_GAP = 0.35
POSITION = r"\\pos\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)"


def parameters(max_gap: float = MAX_GAP, least: float = RATIO, overlap: int = T.OVERLAP) -> dict[str, float]:
    """What ``merge_neighbours`` takes, under the names that a review of the strategy uses."""
    return {"merge_max_gap_sec": float(max_gap), "merge_min_ratio": float(least), "merge_min_overlap_len": float(int(overlap))}


def merged_with(events: DataFrame, params: dict[str, float]) -> DataFrame:
    """``merge_neighbours`` under such parameters; those that aren't given are the usual ones."""
    p = parameters() | params
    return merge_neighbours(events, p["merge_max_gap_sec"], p["merge_min_ratio"], int(p["merge_min_overlap_len"])).withColumnRenamed("island", "seq").drop("n")


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper of two; null if empty."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def upper_median_of(name: str) -> Column:
    """The same as an aggregate over a column, which holds no list: the lower median of the negated values, negated."""
    return F.expr(f"-percentile_disc(0.5) within group (order by -`{name}`)")


def position(tags: Column) -> Column:
    at = lambda k: F.regexp_extract(tags, POSITION, k).try_cast("int")
    return F.struct(at(1).alias("x"), at(2).alias("y"))


def tags_close(a: Column, b: Column, near: int = NEAR_PX) -> Column:
    """Positions within ``near`` pixels; tags without a position must be equal."""
    pair = F.struct(position(a).alias("a"), position(b).alias("b"))
    off = lambda p, k: F.abs(p["a"][k] - p["b"][k]) <= near
    return T.let(pair, lambda p: F.when(p["a"]["x"].isNotNull() & p["b"]["x"].isNotNull(), off(p, "x") & off(p, "y")).otherwise(a == b))


def timed(events: DataFrame) -> DataFrame:
    """Adds _start and _end: seconds of the formatted times, which is what durations and gaps go by."""
    text = lambda c: timefmt.to_seconds(F.col(c)) if c in events.columns else timefmt.to_seconds(timefmt.from_seconds(F.col(c.replace("time", "sec"))))
    return events.withColumns({"_start": text("start_time"), "_end": text("end_time")})


def drop_noise(events: DataFrame) -> DataFrame:
    """Without noise; scene texts also go if they last under 0.35 s and have under 3 characters."""
    e = timed(events)
    lasts = F.coalesce(F.col("_end") - F.col("_start"), F.lit(0.0))
    brief = (F.col("style") == "Scene") & (lasts > 0) & (lasts < 0.35) & (F.length(T.canonical(F.col("body"))) < 3)
    return e.where(~T.is_noise(F.col("body")) & ~F.coalesce(brief, F.lit(False))).select(events.columns)


def merge_neighbours(events: DataFrame, max_gap: float = MAX_GAP, least: float = RATIO, overlap: int = T.OVERLAP) -> DataFrame:
    """roi (and video), island, start_sec, end_sec (of the last), style, tags, body (majority), n: from (roi, seq, start_sec, end_sec, style, tags, body).

    Where there are start_time and end_time, texts, they are the formatted times, and come along. Neighbours in order of formatted start, then seq, join if style, place and body are alike and the gap between
    their formatted times is small. A merged scene stands at the upper medians of its positions.
    """
    keys = track_of(events)
    w = W.partitionBy(*keys).orderBy("_start", "seq")
    e = timed(events).withColumn("canon", T.canonical(F.col("body"), overlap))
    was = {c: F.lag(c).over(w) for c in ("style", "tags", "_end", "canon")}
    e = e.withColumns({f"p_{c}": v for c, v in was.items()})
    near = (F.col("style") == F.col("p_style")) & (F.col("_start") - F.col("p__end")).between(OVERLAP_SEC, max_gap)
    close = F.when(F.col("style") == "Scene", tags_close(F.col("p_tags"), F.col("tags"))).otherwise(F.col("tags") == F.col("p_tags"))
    asks = lambda c: F.when(near & close, F.col(c))  # noqa: E731  the others' texts needn't go through Python
    joins = F.coalesce(T.bodies_similar(asks("p_canon"), asks("canon"), least), F.lit(False))
    e = e.withColumn("island", F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # bodies vote by how often their canonical text stands in the island, then by its length and order; the longest of those is taken
    votes = F.count(F.lit(1)).over(W.partitionBy(*keys, "island", "canon"))
    best = F.min(F.struct((-F.col("votes")).alias("v"), (-F.length("canon")).alias("l"), "canon", (-F.length("body")).alias("n"), "seq", "body"))["body"]
    at, texts = position(F.col("tags")), [c for c in ("start_time", "end_time") if c in events.columns]
    span = e.withColumns({"votes": votes, "x": at["x"], "y": at["y"]}).groupBy(*keys, "island").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_start", "seq", "start_sec", "style", "tags", *texts[:1])).alias("head"), F.max(F.struct("_start", "seq", "end_sec", *texts[1:])).alias("tail"),
        upper_median_of("x").cast("int").alias("x"), upper_median_of("y").cast("int").alias("y"), best.alias("body"),
    )
    tags = F.when((F.col("n") > 1) & (F.col("head.style") == "Scene") & F.col("x").isNotNull(), F.format_string(r"{\an5\pos(%d,%d)}", "x", "y")).otherwise(F.col("head.tags"))
    return span.select(*keys, "island", F.col("head.start_sec").alias("start_sec"), F.col("tail.end_sec").alias("end_sec"), *[F.col(f"{side}.{c}") for side, c in zip(("head", "tail"), texts)], F.col("head.style").alias("style"), tags.alias("tags"), "body", "n")


def fragment_groups(events: DataFrame) -> DataFrame:
    """Adds grp, the seq of the first event of each run of scene fragments; other events are runs of their own.

    A fragment stands where the *first* of its run does and follows the last one closely; noise never joins. That
    compares with a moving anchor: a fold over each track in order of formatted start (``fold.runs``).
    """
    e = timed(events).withColumns({"seq": F.col("seq").cast("long"), "_noise": T.is_noise(F.col("body")), "_x": position(F.col("tags"))["x"], "_y": position(F.col("tags"))["y"]})
    look = ["style", "tags", "_start", "_end", "_noise", "_x", "_y"]
    return fold.runs(e, track_of(events), ["_start", "seq"], "seq", look, _fragment, name="grp").select(*events.columns, "grp")


def _fragment(first: dict, last: dict, now: dict) -> bool:
    if not now["style"] == first["style"] == "Scene" or now["_noise"]:
        return False
    placed = None not in (now["_x"], first["_x"])
    if not (abs(now["_x"] - first["_x"]) <= NEAR_PX and abs(now["_y"] - first["_y"]) <= NEAR_PX if placed else now["tags"] == first["tags"]):
        return False
    return None not in (now["_start"], last["_end"]) and OVERLAP_SEC <= now["_start"] - last["_end"] <= FRAGMENT_GAP


def merge_fragments(events: DataFrame, client: Callable[[str], str], ledger: str | None = None) -> DataFrame:
    """roi, seq, start_sec, end_sec, style, tags, body: runs of scene fragments as one event with the client's body.

    The client sees a run's candidates; without an answer of its own the longest of them stands. Runs of one event
    stay as they are, and the client isn't asked. With ``ledger``, nothing is asked twice (``ledger.kept``).
    """
    from glyphflow.operators.ledger import kept
    from glyphflow.operators.polish import fragment_text

    grouped, keys = fragment_groups(events), track_of(events)
    at = position(F.col("tags"))
    span = grouped.withColumns({"x": at["x"], "y": at["y"]}).groupBy(*keys, F.col("grp").alias("seq")).agg(
        F.min_by("start_sec", "seq").alias("start_sec"), F.max_by("end_sec", F.struct("start_sec", "seq")).alias("end_sec"), F.min_by("style", "seq").alias("style"), F.min_by("tags", "seq").alias("head"),
        F.transform(F.sort_array(F.collect_list(F.struct("start_sec", "seq", "body"))), lambda m: m["body"]).alias("bodies"), upper_median_of("x").cast("int").alias("x"), upper_median_of("y").cast("int").alias("y"),
    )
    tags = F.when((F.size("bodies") > 1) & F.col("x").isNotNull(), F.format_string(r"{\an5\pos(%d,%d)}", "x", "y")).otherwise(F.col("head"))

    @F.pandas_udf("string")
    def chosen(bodies: pd.Series) -> pd.Series:
        ask = kept(client, ledger)

        def one(own) -> str:
            own = list(own)
            return own[0] if len(own) == 1 else fragment_text(ask, own) or max(own, key=lambda b: len(b.strip()))

        return bodies.map(one)

    return span.select(*keys, "seq", "start_sec", "end_sec", "style", tags.alias("tags"), chosen("bodies").alias("body"))
