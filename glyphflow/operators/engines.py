"""Recognition engines: what one must offer, which are known, and how their raw results become records.

An engine is any class with the methods of ``Engine``; none comes with the library. Raw results are JSON (a column,
from a table or from ``recognise``), and become records by array expressions. A record has five arrays of one length:
dt_polys, rec_polys, rec_texts, rec_scores, rec_boxes.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions import text as T
from glyphflow.operators import image

POLY = "array<array<double>>"
LINE = f"struct<poly:{POLY},text:string,score:double,box:array<int>>"
PREFERRED = "paddle"


class Engine(Protocol):
    """Made once for each Python worker; ``normalizer`` names the rule that its raw results go by."""

    engine_id: str
    name: str
    normalizer: str

    @classmethod
    def is_available(cls) -> bool: ...

    def initialize(self) -> None: ...

    def predict(self, bgr: Any) -> Any:
        """What the engine says of an image, as values that JSON can hold."""
        ...

    def cleanup(self) -> None: ...


class Registry:
    """Known engines by id, in order of their registration."""

    def __init__(self) -> None:
        self._known: dict[str, type] = {}

    def register(self, engine: type) -> type:
        missing = [m for m in ("engine_id", "normalizer", "is_available", "predict") if not hasattr(engine, m)]
        if missing:
            raise TypeError(f"{engine.__name__} has no {', '.join(missing)}")
        self._known[engine.engine_id] = engine
        return engine

    def all(self) -> list[str]:
        return list(self._known)

    def available(self) -> list[str]:
        return [k for k, e in self._known.items() if e.is_available()]

    def get(self, engine_id: str) -> type | None:
        return self._known.get(engine_id)

    def default(self) -> str:
        """The preferred engine if it is available, else the first that is, else an empty name."""
        there = self.available()
        return PREFERRED if PREFERRED in there else next(iter(there), "")


REGISTRY = Registry()
_live: dict[type, Any] = {}


def instance(engine: type) -> Any:
    """The engine of this worker, initialised on first use. Another one that lives here is cleaned up."""
    if engine not in _live:
        for old in list(_live):
            _live.pop(old).cleanup()
        made = engine(device=device()) if "device" in inspect.signature(engine).parameters else engine()
        made.initialize()
        _live[engine] = made
    return _live[engine]


def device() -> str:
    """The device that this task was given: the address of its first GPU (``cuda:0``), else ``cpu``."""
    from pyspark import TaskContext

    own = TaskContext.get()
    gpus = own.resources().get("gpu") if own is not None else None
    return f"cuda:{gpus.addresses[0]}" if gpus is not None and gpus.addresses else "cpu"


def stage_profile(spark: SparkSession, cores: int = 4, memory: str = "8g", worker_memory: str = "4g", gpus: int = 0, task_cpus: int = 1, gpu_share: float = 1.0, discovery: str = "") -> ResourceProfile | None:
    """What executors and tasks of the recognition stage get, while other stages keep the session's; None in local mode, where
    there is one process for all.

    A task takes ``task_cpus`` cores and ``gpu_share`` of a GPU (0.5: two tasks on one); ``discovery`` is the script that
    finds an executor's GPUs.
    """
    if spark.sparkContext.master.startswith("local"):
        return None
    executor = ExecutorResourceRequests().cores(cores).memory(memory).pysparkMemory(worker_memory)
    task = TaskResourceRequests().cpus(task_cpus)
    if gpus:
        executor, task = executor.resource("gpu", gpus, discovery), task.resource("gpu", gpu_share)
    return ResourceProfileBuilder().require(executor).require(task).build


def recognise(crops: DataFrame, engine: type | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """``crops`` without pixels, with the record of each (rec): the engine's raw result, normalised.

    Without ``engine`` the default of the registry is used; with none there, that is an error. ``profile`` is what the stage
    needs of executors (``stage_profile``); an engine that takes a ``device`` gets the task's.
    """
    import json

    import pandas as pd

    engine = engine or REGISTRY.get(REGISTRY.default())
    if engine is None:
        raise RuntimeError("no recognition engine is available")
    keep = [c for c in crops.columns if c not in ("h", "w", "image")]

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            raw = [json.dumps(instance(engine).predict(image.decode(b, h, w)), ensure_ascii=False) for b, h, w in zip(page["image"], page["h"], page["w"])]
            yield page[keep].assign(raw=raw)

    kind = crops.select(*keep, F.lit("").alias("raw")).schema
    return crops.mapInPandas(run, kind, profile=profile).withColumn("rec", normalised(F.col("raw"), engine.normalizer)).drop("raw")


def _record(lines: Column) -> Column:
    """A record from an array of lines (``LINE``), which is computed once."""

    def arrays(own: Column) -> Column:
        get = lambda k: F.transform(own, lambda m: m[k])
        return F.struct(get("poly").alias("dt_polys"), get("poly").alias("rec_polys"), get("text").alias("rec_texts"), get("score").alias("rec_scores"), get("box").alias("rec_boxes"))

    return T.let(lines, arrays)


def _parts(item: Column, body) -> Column:
    """``body(parts, polygon)`` of a JSON array that begins with a polygon, each read once."""
    return T.let(F.from_json(item, "array<string>"), lambda parts: T.let(F.from_json(F.get(parts, F.lit(0)), POLY), lambda poly: body(parts, poly)))


def _around(poly: Column, whole: bool = False) -> Column:
    """The box around a polygon, cut towards zero; with ``whole``, of its points cut first."""
    at = lambda k: F.transform(poly, lambda p: F.get(p, F.lit(k)).cast("int") if whole else F.get(p, F.lit(k)))
    return F.array(*[f(at(k)).cast("int") for f, k in ((F.array_min, 0), (F.array_min, 1), (F.array_max, 0), (F.array_max, 1))])


def _line(poly: Column, text: Column, score: Column, box: Column) -> Column:
    return F.struct(poly.alias("poly"), text.alias("text"), score.cast("double").alias("score"), box.alias("box"))


def _items(raw: Column) -> Column:
    """The elements of a JSON array, each as JSON; none of anything else."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.expr("cast(array() as array<string>)"))


def _score(text: Column, missing: float) -> Column:
    """A score as JSON: absent, ``missing``; null, false, empty or zero, 0."""
    return F.when(text.isNull(), F.lit(missing)).otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)))


def by_document(raw: Column) -> Column:
    """A document (one object of parallel arrays, cut to the shortest) or lines ([polygon, [text, score]])."""
    kind = f"array<struct<rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<{POLY}>,rec_boxes:array<array<double>>>>"

    def whole(d: Column) -> Column:
        n = F.least(*[F.greatest(F.coalesce(F.size(d[c]), F.lit(0)), F.lit(0)) for c in ("rec_texts", "rec_scores", "rec_polys", "rec_boxes")])
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(at, lambda i: _line(F.get(d["rec_polys"], i), F.get(d["rec_texts"], i), F.get(d["rec_scores"], i), F.get(d["rec_boxes"], i).cast("array<int>")))

    def line(parts: Column, poly: Column) -> Column:
        read = lambda said: F.when((F.size(parts) == 2) & (F.size(said) == 2) & poly.isNotNull(), _line(poly, F.get(said, F.lit(0)), F.get(said, F.lit(1)).try_cast("double"), _around(poly, True)))
        return T.let(F.from_json(F.get(parts, F.lit(1)), "array<string>"), read)

    def read(items: Column) -> Column:
        lines = F.filter(F.transform(items, lambda item: _parts(item, line)), lambda m: m.isNotNull())
        single = (F.size(items) == 1) & F.coalesce(F.get(items, F.lit(0)).startswith("{"), F.lit(False))
        return F.when(single, T.let(F.get(F.from_json(raw, kind), F.lit(0)), whole)).otherwise(lines)

    return _record(T.let(_items(raw), read))


def _triple(parts: Column, poly: Column) -> Column:
    score = F.when(F.size(parts) == 2, F.lit(1.0)).otherwise(_score(F.coalesce(F.get(parts, F.lit(2)), F.lit("0")), 0.0))
    return F.when(F.size(parts).isin(2, 3) & poly.isNotNull(), _line(poly, F.coalesce(F.get(parts, F.lit(1)), F.lit("")), score, _around(poly)))


def by_triple(raw: Column) -> Column:
    """Lines ([polygon, text, score]); without a score it is 1, with a null, empty or zero one 0. Other lengths go."""
    return _record(F.filter(F.transform(_items(raw), lambda item: _parts(item, _triple)), lambda m: m.isNotNull()))


def by_mixed(raw: Column) -> Column:
    """Objects {text, confidence or score, box of 4, or of 8 and more flat} or lines as of ``by_triple``; blank texts go."""

    def obj(o: Column) -> Column:
        b = o["box"]
        x1, y1, x2, y2 = (F.get(b, F.lit(k)) for k in range(4))
        corners = F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(b) / 2).cast("int") - 1), lambda i: F.array(F.get(b, 2 * i), F.get(b, 2 * i + 1)))
        edge = lambda k, f: f(F.filter(b, lambda _, i: i % 2 == k)).cast("int")  # noqa: E731  an odd last number is an x
        ring = F.array(edge(0, F.array_min), edge(1, F.array_min), edge(0, F.array_max), edge(1, F.array_max))
        score = F.coalesce(o["confidence"], o["score"], F.lit(0.0))
        return F.when(F.size(b) == 4, _line(corners, o["text"], score, b.cast("array<int>"))).when(F.size(b) >= 8, _line(pairs, o["text"], score, ring))

    fields = "struct<text:string,confidence:double,score:double,box:array<double>>"
    row = lambda parts, poly: F.when(F.size(poly) >= 4, _triple(parts, poly))
    single = lambda item: F.when(item.startswith("{"), T.let(F.from_json(item, fields), obj)).otherwise(_parts(item, row))
    return _record(F.filter(F.transform(_items(raw), single), lambda m: m.isNotNull() & ~T.is_blank(F.coalesce(m["text"], F.lit("")))))


NORMALIZERS = {"document": by_document, "triple": by_triple, "mixed": by_mixed}


def normalised(raw: Column, rule: str) -> Column:
    """The record of a raw result (JSON) by the rule of that name."""
    return NORMALIZERS[rule](raw)
