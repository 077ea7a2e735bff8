"""The main query does each step once, and folds again only what an earlier partition may change."""

import random

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from glyphflow.functions import text as T
from glyphflow.operators import fold, merge, segment
from glyphflow.plans import subtitles, views


def test_only_first_tracks_are_folded_again(spark, monkeypatch):
    rows = spark.range(4000).select(F.floor(F.col("id") / 100).alias("roi"), (F.col("id") % 100).alias("frame"))
    again, whole = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **b: (f.__name__ == "run" and again.append(self.count()), whole(self, f, *a, **b))[1])
    found = fold.runs(rows, ["roi"], ["frame"], "frame", [], lambda anchor, last, now: now["frame"] - anchor["frame"] < 30, parts=6)
    assert found.where("run <> frame - frame % 30").count() == 0 and found.count() == 4000
    assert again and sum(again) <= 5 * 100


def test_events_meet_python_once_and_groups_are_made_once(spark, tiny):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(merge.merge_neighbours(views.subtitles(spark, tiny))).count("ArrowEvalPython") == 1
    assert "Window" not in plan(subtitles.raw_events(views.track(spark, tiny)))  # the steps between times are stored with the groups


def test_alike_as_by_the_whole_table():
    rnd = random.Random(3)
    for _ in range(3000):
        a = "".join(rnd.choices("abc", k=rnd.randint(0, 30)))
        b = "".join(c for c in a if rnd.random() > 0.1) + rnd.choice(["", "c", "ab"]) if rnd.random() < 0.5 else "".join(rnd.choice("ab") if rnd.random() < 0.15 else c for c in a)
        want = bool(a and b) and 2 * T.subsequence(a, b) / (len(a) + len(b)) >= segment.SIMILAR
        assert segment._alike(a, b) == want, (a, b)
