"""One roi longer than a task should hold: its frames are folded by many tasks, and the runs are those of one fold."""

from pyspark.sql import functions as F

from glyphflow.operators import fold, segment

N = 120_000


def test_one_long_roi(spark, monkeypatch):
    """Texts that last seven frames, but one that stays over half of the track, and a gap in the middle of it."""
    n = F.col("frame")
    still = (n >= 20_000) & (n < 80_000)
    text = F.when(still, F.lit("a notice that stays on the screen")).otherwise(F.concat(F.lit("line "), F.repeat(F.chr(97 + F.floor(n / 7).cast("int") % 26), F.lit(9))))
    line = F.struct(F.lit(0).cast("long").alias("seq"), text.alias("text"), F.lit(5.0).alias("x"), F.lit(9.0).alias("y"), F.lit(8.0).alias("top"), F.lit(2.0).alias("height"))
    framed = spark.range(N).where("id < 50000 or id > 50020").select(F.lit("roi_0").alias("roi"), F.col("id").alias("frame"), (F.col("id") * 0.04).alias("time_sec"), F.array(line).cast(f"array<{segment.LINE}>").alias("lines"))
    rounds = []
    whole = fold._again
    monkeypatch.setattr(fold, "_again", lambda *a: rounds.append(1) or whole(*a))
    found = segment.marked(framed, parts=24)
    want = F.when(still & (n < 50_000), 20_000).when(still, 50_021).otherwise(F.greatest(n - n % 7, F.when(n >= 80_000, 80_000).otherwise(0)))
    bad = found.select("frame", "run", want.cast("long").alias("want"))
    assert bad.count() == N - 21 and bad.where("run <> want").limit(5).collect() == []
    assert 1 <= len(rounds) <= 8  # the notice lies over a dozen partitions
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_workers_hold_small_batches(spark):
    """Python takes 1,000 rows of a fold at a time, whatever a partition holds, unless the session has a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, most = spark.conf.get(key), 1 << 20
    rows = spark.range(5000).select(F.lit("roi_0").alias("roi"), F.col("id").alias("frame"))

    def goes_on(anchor, last, now):
        import sys

        assert sys._getframe(1).f_locals["batch"].num_rows <= most
        return now["frame"] % 7 > 0

    want = {k: k - k % 7 for k in range(5000)}
    try:
        for own, most, then in (("10000", 1000, "1000"), ("3000", 3000, "3000")):
            spark.conf.set(key, own)
            assert {r.frame: r.run for r in fold.runs(rows, ["roi"], ["frame"], "frame", [], goes_on, parts=1).collect()} == want
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, was)
