"""Cohort retention kept up to date by signed deltas.

A client's start is the earliest of its clicks that count as a start; the day of the start is its cohort, and each click
from the start on falls into a period counted from it. ``materialise`` makes the tables of a first state: the rows it
knows, each client's start, each client's contribution to each period, and the cells of the matrix. ``advance`` doesn't
make them again. Late rows can only bring a start forward, so it finds the clients whose start they shift, retracts what
these contributed (-1), adds all their clicks again under the new start (+1), and for all other clients adds only what
the late rows themselves bring. The cells of the new state are those of the old one plus the signed sums.

Nothing but cells is gathered by a key that many rows share: a client's rows are summed where they are read (starts), or
after a join that adaptive execution can split, because its sums are dealt out anew by client and period. Starts, and
contributions, are one row for each client (and period), also of a client with a third of all rows. All tables between
steps lie in the shared folder, so a lost executor costs the tasks it had.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm._common import stored

DAY = 86_400_000_000  # microseconds
CELL = ["segment", "cohort", "period"]
SUMS = ["users", "users_crc32", "moved", "cents"]


@dataclass(frozen=True)
class State:
    """history: client_id, ts (microseconds), begins, cents; starts: client_id, segment, cohort, start; parts: client_id,
    segment, cohort, period, cents; cells: segment, cohort, period, users, users_crc32, cents; segments: client_id,
    segment; moved: segment, cohort, period, before, after: users whose cohort the last ``advance`` changed, in cells of
    the state before and of this one (null for a first state)."""

    history: DataFrame
    starts: DataFrame
    parts: DataFrame
    cells: DataFrame
    segments: DataFrame
    width: int
    moved: DataFrame | None = None


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a civil time, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return days * DAY + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + seconds


def _rows(clicks: DataFrame, begins: Column) -> DataFrame:
    """client_id, ts, begins, cents of the rows that count, equal rows once."""
    value = F.col("value").cast("double")
    cents = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.floor(value * 100 + 0.5)).otherwise(0)
    once = clicks.where("ts is not null and client_id is not null").distinct()
    return once.select("client_id", micros(F.col("ts")).alias("ts"), F.coalesce(begins, F.lit(False)).alias("begins"), F.coalesce(cents, F.lit(0)).cast("long").alias("cents"))


def _earliest(rows: DataFrame) -> DataFrame:
    return rows.where("begins").groupBy("client_id").agg(F.min("ts").alias("start"))


def _floored(x: Column, by: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def _met(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows from their client's start on, with the columns of ``starts``."""
    return rows.select("client_id", "ts", "cents").join(starts.hint("merge"), "client_id").where("ts >= start")


def _spread(met: DataFrame, width: int, *also: str) -> DataFrame:
    """client_id, segment, cohort, period, cents (and ``also``) of such rows.

    They come from a join by client; their sums go by a struct, so that they are dealt out anew and the join of a hot client
    can be split.
    """
    at = F.struct("client_id", "segment", "cohort", _floored(F.col("ts") - F.col("start"), width * DAY).alias("period"), *also)
    return met.groupBy(at.alias("at")).agg(F.sum("cents").alias("cents")).select("at.*", "cents")


def _counted(parts: DataFrame, sign: Column, users: Column | None = None) -> DataFrame:
    """One signed row for each part, in the columns of cells."""
    users = sign if users is None else users
    crc = F.crc32(F.col("client_id").cast("string"))
    return parts.select(*CELL, users.cast("long").alias("users"), (users * crc).cast("long").alias("users_crc32"), (sign * F.col("cents")).cast("long").alias("cents"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in ("users", "users_crc32", "cents")))


def materialise(clicks: DataFrame, clients: DataFrame, begins: Column | None = None, width: int = 1) -> State:
    """The first state, of ``clicks`` (client_id, ts, value and any other columns) and ``clients`` (client_id, segment).

    Equal rows count once; rows that differ in any column are rows of their own. Rows without ts or client_id don't
    count, nor do rows before their client's start; a client without a start has no cell. ``begins`` says which rows can be
    starts (null: not; by default those of kind signup). ``width`` is the days of a cohort and of a period. A client
    that isn't in ``clients``, or whose segment is null, has segment ''; of several segments the smallest counts. Null, NaN
    and infinite values are 0 cents. Empty tables give no cells.
    """
    begins = F.col("kind") == "signup" if begins is None else begins
    history = stored(_rows(clicks, begins), "history")
    segments = stored(clients.where("client_id is not null").groupBy("client_id").agg(F.min("segment").alias("segment")), "segments")
    starts = stored(_labelled(_earliest(history), segments, width), "starts")
    parts = stored(_spread(_met(history, starts), width), "parts")
    return State(history, starts, parts, stored(_summed(_counted(parts, F.lit(1))), "cells"), segments, width)


def _labelled(starts: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    named = starts.join(segments.hint("merge"), "client_id", "left")
    return named.select("client_id", F.coalesce("segment", F.lit("")).alias("segment"), _floored(F.col("start"), width * DAY).alias("cohort"), "start")


def advance(state: State, late: DataFrame, begins: Column | None = None) -> State:
    """The state after ``late`` clicks, which have the columns and rules of ``materialise``.

    Rows count once within ``late``; a row that the state knows already must not come again. A late start that isn't
    earlier than the known one shifts nothing and counts as any click. Without late rows the cells stay as they are.
    """
    begins = F.col("kind") == "signup" if begins is None else begins
    came = stored(_rows(late, begins), "late")
    brought = _labelled(_earliest(came), state.segments, state.width)
    old = state.starts.select("client_id", F.col("start").alias("start_before"), F.col("cohort").alias("cohort_before"))
    shifted = stored(brought.join(old.hint("merge"), "client_id", "left").where("start_before is null or start < start_before").withColumn("moves", F.coalesce(F.col("cohort") != F.col("cohort_before"), F.lit(False))), "shifted")

    new = shifted.select("client_id", "segment", "cohort", "start", F.lit(True).alias("shifts"), "moves")
    kept = state.starts.join(shifted.select("client_id").hint("merge"), "client_id", "left_anti").select("client_id", "segment", "cohort", "start", F.lit(False).alias("shifts"), F.lit(False).alias("moves"))
    starts = stored(kept.unionByName(new), "starts")
    again = _met(state.history, new).unionByName(_met(came, starts))
    added = stored(_spread(again, state.width, "shifts", "moves"), "added")

    retracted = state.parts.join(shifted.select("client_id", "moves").hint("merge"), "client_id")
    known = state.parts.select("client_id", "period", F.lit(True).alias("known"))
    others = added.where("not shifts").join(known.hint("merge"), ["client_id", "period"], "left")
    signed = _counted(retracted, F.lit(-1)).unionAll(_counted(added.where("shifts"), F.lit(1))).unionAll(_counted(others, F.lit(1), F.when(F.col("known"), 0).otherwise(1)))
    cells = stored(_summed(state.cells.unionAll(signed)).where("users > 0"), "cells")

    was, now = retracted.where("moves").select(*CELL, F.lit(1).alias("before"), F.lit(0).alias("after")), added.where("moves").select(*CELL, F.lit(0).alias("before"), F.lit(1).alias("after"))
    moved = stored(was.unionAll(now).groupBy(*CELL).agg(F.sum("before").alias("before"), F.sum("after").alias("after")), "moved")
    rest = state.parts.join(shifted.select("client_id").hint("merge"), "client_id", "left_anti")
    parts = rest.unionByName(added.select(rest.columns)).groupBy("client_id", *CELL).agg(F.sum("cents").alias("cents"))
    return State(state.history.unionByName(came), starts.drop("shifts", "moves"), parts, cells, state.segments, state.width, moved)


def matrix(before: State, after: State) -> DataFrame:
    """state (0 or 1), segment, cohort, period, users, users_crc32, moved, cents: the cells of a state and of the next one;
    ``moved`` are users that have a start in both and another cohort in each."""
    zero = F.lit(0).cast("long")
    rows = None
    for n, state, side in ((0, before, "before"), (1, after, "after")):
        own = state.cells.select(*CELL, "users", "users_crc32", zero.alias("moved"), "cents")
        shift = after.moved.select(*CELL, zero.alias("users"), zero.alias("users_crc32"), F.col(side).cast("long").alias("moved"), zero.alias("cents"))
        both = own.unionAll(shift).select(F.lit(n).alias("state"), "*")
        rows = both if rows is None else rows.unionAll(both)
    return rows.groupBy("state", *CELL).agg(*(F.sum(c).alias(c) for c in SUMS)).where("users > 0")
