import datetime as dt
import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.llm import curve, queries


@pytest.mark.parametrize("dims, bits", [(1, 5), (2, 1), (2, 5), (3, 3), (4, 2)])
def test_steps(dims, bits):
    """Every cell has a place of its own, and neighbours on the curve differ by one in one column."""
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = curve.places(list(cells.T), bits)
    assert sorted(at) == list(range(1 << bits * dims))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def law_holds(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    return [len(by.get(s, [])) for s in range(shards)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = queries.op12_sharding(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    counts = law_holds(rows, 16)
    assert max(counts) - min(counts) <= 1 and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    data = lambda d: (d.text or "").encode()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d.doc_id, len(data(d)) + 1, zlib.crc32(data(d))) for d in docs)


def test_order_is_the_curve(spark):
    """Rows go by the place of their cell, worked out here from the quantiles alone."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = curve.layout(docs, ["lang", "n_chars"], 7).collect()
    points = docs.select("doc_id", curve.coordinate(docs, "lang").alias("d0"), curve.coordinate(docs, "n_chars").alias("d1"))
    edges = curve.quantiles(points, ["d0", "d1"], curve.BITS)
    cell = lambda v, e: 0 if v is None else sum(x < v for x in e)
    want = {r.doc_id: int(curve.places([[cell(r.d0, edges[0])], [cell(r.d1, edges[1])]], curve.BITS)[0]) for r in points.collect()}
    assert all(r.curve == want[r.doc_id] for r in rows)
    at = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert at == sorted(at)


def test_bytes(spark):
    """Each shard's bytes are within the largest row of an even share."""
    rnd = random.Random(3)
    rows = spark.createDataFrame([(i, rnd.choice([1, 5, 40, 900]), rnd.random()) for i in range(500)], "id long, b long, x double")
    found = curve.layout(rows, ["x"], 6, law="bytes", size=F.col("b")).collect()
    law_holds(found, 6)
    sums = [sum(r.b for r in found if r.shard == s) for s in range(6)]
    assert all(abs(s - sum(sums) / 6) <= 900 for s in sums)


def test_odd_rows(spark):
    """Nulls, NaN, repeats, a hot cell, columns with the names of new ones, times and dates; few rows and none."""
    rows = [(i % 50 if i % 7 else None, "hot" if i % 3 else None, float("nan") if i % 5 == 0 else float(i), dt.datetime(2024, 1, 1 + i % 20), dt.date(2024, 1, 1), "é" * (i % 4), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, kind string, x double, at timestamp_ntz, day date, name string, slot int").selectExpr("*", "2 as shard", "3 as part", "4 as row", "5 as rank", "6 as `a.b`")
    laid = curve.layout(df, ["kind", "x", "at", "day", "name", "a.b"], 9, run_rows=10)
    found = laid.collect()
    assert len(found) == 400 and max(law_holds(found, 9)) - min(law_holds(found, 9)) <= 1 and {r.run for r in found} == {0, 1, 2, 3, 4}
    spelt = lambda rs: sorted(str([r[c] for c in ("id", "kind", "x", "at", "day", "name", "part", "row", "rank", "a.b")]) for r in rs)
    assert spelt(found) == spelt(df.collect())
    assert law_holds(curve.layout(df.limit(3), ["x"], 9).collect(), 9).count(1) == 3
    assert curve.layout(df.limit(0), ["x"], 9).collect() == []
    assert curve.layout(df.limit(0), ["x"], 9, law="bytes").collect() == []
    with pytest.raises(ValueError):
        curve.layout(df, ["x"], 9, law="key")


def test_files_are_pruned(spark, tmp_path):
    """A box in two columns meets few runs, and those hold all of its rows."""
    rnd = np.random.default_rng(2)
    x, y = rnd.random(6000), rnd.random(6000)
    df = spark.createDataFrame(list(zip(range(6000), x.tolist(), y.tolist())), "id long, x double, y double")
    laid = curve.layout(df, ["x", "y"], 8, run_rows=50)
    path = str(tmp_path / "shards")
    curve.write(laid, path)
    back = spark.read.parquet(path)
    runs = curve.overlapping(curve.manifest(back, ["x", "y"]), {"x": (0.2, 0.3), "y": (0.6, 0.7)})
    total, met = math.ceil(750 / 50) * 8, runs.count()
    inside = back.where("x between 0.2 and 0.3 and y between 0.6 and 0.7")
    assert inside.join(runs, ["shard", "run"], "left_anti").count() == 0 < inside.count()
    assert met <= 0.15 * total and len([d for d in os.listdir(path) if d.startswith("shard=")]) == 8
