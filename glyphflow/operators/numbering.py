"""Numbers of rows within their group, also where a group has more rows than a task should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphflow.operators.staging import staged


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with ``name``, from 0 in ``order`` within equal ``keys`` (nulls being equal); equal rows go in any order.

    Rows are sorted over range partitions and numbered in each. Only a partition's first and last group can go on in
    others, so what stands before a part of one is a table of two rows a partition at most.
    """
    at = F.monotonically_increasing_id()
    key = F.struct(*keys) if keys else F.lit(0)
    held = staged(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)), "numbered")
    sizes = held.groupBy(key.alias("_key"), "_part").agg(F.count(F.lit(1)).alias("_c"))
    edges = held.groupBy("_part").agg(F.min_by(key, "_at").alias("a"), F.max_by(key, "_at").alias("b")).select(F.col("_part").alias("_p"), F.explode(F.array_distinct(F.array("a", "b"))).alias("_k"))
    ends = sizes.join(edges, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))).select("_k", "_p", "_c")
    before = F.sum("_c").over(W.partitionBy("_k").orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    goes_on = ends.withColumn("_before", before).where("_before > 0").drop("_c")
    own = held.withColumns({"_own": F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_at")) - 1, "_key": key})
    met = own.join(F.broadcast(goes_on), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    return met.select(*rows.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
