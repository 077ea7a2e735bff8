"""Batch runs stop within seconds and leave nothing; stages ask for what they need."""

import os
import time

import pytest
from pyspark.sql import functions as F

from glyphflow.operators import engines
from glyphflow.streaming import control


def slow(spark, seconds):
    def run(pages):
        for page in pages:
            time.sleep(seconds)
            yield page

    return spark.range(0, 64, 1, 64).mapInPandas(run, "id long")


def test_a_run_is_stopped(spark, tmp_path):
    """The rows of the first tasks are written when the flag goes up, but nothing of them is there afterwards."""
    path, began, seen = str(tmp_path / "out"), time.time(), []
    run = control.Run(spark, lambda: slow(spark, 1.0).write.parquet(path))
    other = control.Run(spark, lambda: spark.range(100).count())
    assert not control.ended(run, lambda: time.time() - began > 3, seen.append)
    assert time.time() - began < 15 and not os.path.exists(f"{path}/_SUCCESS") and not [f for f in (os.listdir(path) if os.path.isdir(path) else []) if f.startswith("part-")]
    with pytest.raises(control.Cancelled):
        run.result()
    assert other.result() == 100 and seen[-1]["tasks"] >= 64 > seen[-1]["done"]


def test_a_run_ends_or_fails(spark):
    seen = []
    run = control.Run(spark, lambda: spark.range(50).repartition(3).count())
    assert control.ended(run, lambda: False, seen.append) and run.result() == 50 and run.progress()["done"] >= 1
    run = control.Run(spark, lambda: spark.range(5).select(F.raise_error("no")).collect())
    assert control.ended(run, lambda: False)
    with pytest.raises(Exception, match="no"):
        run.result()


class Toy:
    engine_id, name, normalizer = "toy", "Toy", "triple"

    def __init__(self, device):
        self.device = device

    @classmethod
    def is_available(cls):
        return True

    def initialize(self):
        pass

    def predict(self, bgr):
        return [[[[0, 0], [1, 0], [1, 1], [0, 1]], self.device, 1.0]]

    def cleanup(self):
        pass


def test_stage_profile(spark, monkeypatch):
    """In local mode there is none; elsewhere the stage of the recognition, and it alone, asks for cores and GPUs."""
    assert engines.stage_profile(spark) is None
    crops = spark.createDataFrame([("r", 1, 1, 1, bytes([1, 2, 3]))], "roi_id string, frame long, h int, w int, image binary")
    assert engines.recognise(crops, Toy).first().rec.rec_texts == ["cpu"]

    class Elsewhere:
        class sparkContext:
            master = "yarn"

    profile = engines.stage_profile(Elsewhere, cores=8, gpus=2, gpu_share=0.5, discovery="/opt/find.sh")
    assert profile.executorResources["gpu"].amount == 2 and profile.taskResources["gpu"].amount == 0.5 and profile.executorResources["cores"].amount == 8
    given = []
    whole = type(crops).mapInPandas
    monkeypatch.setattr(type(crops), "mapInPandas", lambda self, f, kind, barrier=False, profile=None: given.append(profile) or whole(self, f, kind, barrier))
    engines.recognise(crops, Toy, profile)
    assert given == [profile]
