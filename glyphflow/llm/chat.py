"""Chat formatting by perspective: each participant in turn is the assistant.

A conversation of several parties gives one dialogue for every participant: that speaker's turns are the
assistant's, other speakers are users with their names, system turns stay. The mask says which characters are to be
learnt: the assistant's words and the end token after them. Everything is DataFrame functions. A conversation of more
than ``SEGMENT`` turns is rendered in parts of so many turns, so that no row grows without bound; each part opens with the
system turn in force, the last one before it. Turns are numbered within their conversation by one range sort of all
turns, so that a conversation with a third of them is numbered in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphflow.llm._common import stored

SEGMENT = 4096
START, END = "<|im_start|>", "<|im_end|>"


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds n: the place of a turn in its conversation, from 0.

    Turns are sorted over range partitions and numbered in each. Only a partition's first and last conversation can go on
    in others, so what stands before a part of one is a table of two rows a partition at most.
    """
    at = F.monotonically_increasing_id()
    order = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(*order, F.substring("body", 1, 64)).sortWithinPartitions(*order, "body")
    held = stored(dealt.withColumn("at", at).withColumn("part", F.shiftright("at", 33)), "turns")
    parts = held.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("c"))
    edges = held.groupBy("part").agg(F.min_by(F.struct("conv_id"), "at").alias("a"), F.max_by(F.struct("conv_id"), "at").alias("b"))
    ends = edges.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select(F.col("part").alias("_part"), F.col("e.conv_id").alias("_conv"))
    sizes = ends.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).select("_conv", "_part", "c")
    before = F.coalesce(F.sum("c").over(W.partitionBy("_conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    goes_on = sizes.withColumn("before", before).where("before > 0").drop("c")
    own = F.row_number().over(W.partitionBy("conv_id", "part").orderBy("at")) - 1
    met = held.withColumn("own", own).join(F.broadcast(goes_on), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    return met.select("conv_id", "turn", "role", "body", (F.col("own") + F.coalesce("before", F.lit(0))).alias("n"))


def rotate(turns: DataFrame, segment: int = SEGMENT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segment, speaker, n_turns, text, mask (array of (start, end) in characters).

    Turns go by turn, then role, then text; a null turn comes first, repeated rows are turns of their own. Part n
    (``segment``) holds the turns from ``n * segment`` on in that order, whatever their numbers. A null role is "unknown", a
    null text is empty, a null conv_id is a conversation like others. "<|" within a text becomes "< |", so no text can
    forge a token. Names keep letters, digits, _ and -; other characters become _. A conversation of system turns only
    has no participant and no row; other columns are ignored; no rows give no rows. The system turn that a later segment
    opens with isn't counted in n_turns.
    """
    role = F.coalesce(F.col(role_col), F.lit("unknown"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"))
    rows = _numbered(rows).withColumn("segment", F.floor(F.col("n") / segment).cast("long"))
    speakers = rows.where("role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    said = F.max(F.when(F.col("role") == "system", F.struct("n", "body")))["body"]
    dialogues = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("n", "role", "body"))).alias("own"), said.alias("said"))
    before = F.last("said", ignorenulls=True).over(W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1))
    opened = F.when(F.col("before").isNotNull(), F.concat(F.array(F.struct(F.get("own", F.lit(0))["n"].alias("n"), F.lit("system").alias("role"), F.col("before").alias("body"))), "own")).otherwise(F.col("own"))
    dialogues = dialogues.withColumn("before", before).select("conv_id", "segment", F.size("own").cast("long").alias("n_turns"), opened.alias("turns"))
    seen = dialogues.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def shown(t: Column) -> Column:
        name = F.regexp_replace(t["role"], "[^A-Za-z0-9_-]", "_")
        head = F.when(t["role"] == F.col("speaker"), F.lit("assistant")).when(t["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), name))
        return F.struct(F.concat(F.lit(START), head, F.lit("\n")).alias("head"), F.concat(t["body"], F.lit(END)).alias("tail"), (t["role"] == F.col("speaker")).alias("own"))

    seen = seen.withColumn("shown", F.transform("turns", shown))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["tail"])
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["mask"]).alias("mask"))

    text = F.array_join(F.transform("shown", lambda p: F.concat(p["head"], p["tail"], F.lit("\n"))), "")
    return seen.select("conv_id", "segment", "speaker", "n_turns", text.alias("text"), F.aggregate("shown", empty, step, lambda acc: acc["mask"]).alias("mask"))
