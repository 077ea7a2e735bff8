"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams of 3, 4 and 5 of a text (lower-cased, runs of white space as one space), hashed
into ``2**BITS`` buckets. For each bucket, r is the log of the ratio of its smoothed share among toxic and among
other training texts. A logistic regression is fitted on ``r * presence``; a bucket that few texts hold, or whose
ratio is near 1, weighs nothing. A text's score is the logistic of the sum over its distinct buckets.

Fitting takes at most ``max_train`` labelled rows (the lowest hashes of doc_id; all rows if there are fewer), read
whole. Their buckets are counted in parallel, as are the presences of those buckets that weigh something, which alone
go to the one task that fits the weights. Scoring is a map over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm._common import bounded_sample, discard, small_batches, stored

BITS = 20
ORDERS = (3, 4, 5)
MAX_TRAIN = 8_000


def _hashed(texts: list[str | None]):
    """(document of each n-gram, its bucket), over whole texts; an n-gram lies within one text."""
    import numpy as np

    parts = [b" " + " ".join((t or "").lower().split()).encode("utf-8", "surrogatepass") + b" " for t in texts]
    x = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    docs, buckets, h = [], [], x
    for k in range(2, max(ORDERS) + 1):
        if len(x) < k:
            break
        h = h[:-1] * np.uint32(0x01000193) + x[k - 1 :]
        if k in ORDERS:
            own = doc[: len(h)] == doc[k - 1 :]
            b = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
            docs.append(doc[: len(h)][own])
            buckets.append(((b ^ (b >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))[own])
    if not docs:
        return np.empty(0, np.int32), np.empty(0, np.uint32)
    return np.concatenate(docs), np.concatenate(buckets)


def _distinct(doc, bucket):
    import numpy as np

    key = np.unique((doc.astype(np.int64) << BITS) | bucket)
    return (key >> BITS).astype(np.int32), (key & ((1 << BITS) - 1)).astype(np.int32)


MIN_DOCS, MIN_RATIO = 4, 0.7


def log_ratios(held, bad, toxic: int, others: int):
    """log of the ratio of smoothed shares of toxic and other texts that hold a bucket; 0 for buckets that weigh nothing."""
    import numpy as np

    r = np.log((1.0 + bad) / (toxic + 2)) - np.log((1.0 + held - bad) / (others + 2))
    return np.where((held >= MIN_DOCS) & (np.abs(r) >= MIN_RATIO), r, 0.0)


def fit_weights(doc, at, scale, y, penalty: float = 5e-4, steps: int = 300):
    """(weights, intercept) of a logistic regression on ``scale * presence``: ``at[i]`` is a feature that text ``doc[i]`` holds."""
    import numpy as np

    v, bias = np.zeros(len(scale)), float(np.log(y.mean() / (1 - y.mean())))
    m, s, mb, sb = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the full batch
        z = bias + np.bincount(doc, weights=(v * scale)[at], minlength=len(y))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(at, weights=err[doc], minlength=len(v)) * scale + penalty * v
        gb = err.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        v -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        bias -= 0.02 * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    return (v * scale).astype(np.float32), float(bias)


def score_rows(texts: list[str | None], table, bias: float):
    import numpy as np

    doc, bucket = _hashed(texts)
    hit = table[bucket] != 0
    doc, bucket = _distinct(doc[hit], bucket[hit])
    z = bias + np.bincount(doc, weights=table[bucket], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(buckets, weights, intercept) as numpy arrays and a float.

    ``labels`` holds doc_id and a label of 0 or 1; rows with neither are left out, as are rows for which ``learn``
    (over its columns) doesn't hold. A doc_id with labels of both kinds counts as toxic. Without any label the
    classifier says "not toxic" of all.
    """
    import numpy as np

    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    sample = bounded_sample(known.withColumn("_h", F.xxhash64("_id")), "_h", max_train).drop("_h")  # may be sent to all tasks
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), "_id")
    rows = stored(own.select("_text", "_y", F.xxhash64("_id", "_text").alias("_h")), "labelled")
    there = {r._y: r.n for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, others = there.get(1, 0), there.get(0, 0)
    none = np.empty(0, np.int32), np.empty(0, np.float32)
    if not toxic or not others:
        return *none, float(np.log((toxic + 0.5) / (others + 0.5))) if there else -3.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bad = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for a in range(0, batch.num_rows, 200):
                doc, bucket = _distinct(*_hashed(batch.column(0).slice(a, 200).to_pylist()))
                held += np.bincount(bucket, minlength=1 << BITS).astype(np.int32)
                bad += np.bincount(bucket[y[a + doc] == 1], minlength=1 << BITS).astype(np.int32)
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (at, held[at], bad[at])], names=["bucket", "held", "bad"])

    summed = rows.select("_text", "_y").mapInArrow(count, "bucket int, held int, bad int").groupBy("bucket").agg(F.sum("held").alias("held"), F.sum("bad").alias("bad"))
    counts = summed.where(F.col("held") >= MIN_DOCS).toArrow()  # of 2**BITS buckets at most
    r = log_ratios(counts.column("held").to_numpy().astype(float), counts.column("bad").to_numpy().astype(float), toxic, others)
    names = counts.column("bucket").to_numpy()[r != 0]
    order = np.argsort(names)
    names, scale = names[order].astype(np.int32), r[r != 0][order]
    sent = docs.sparkSession.sparkContext.broadcast((names.tobytes(), scale.tobytes()))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.frombuffer(sent.value[0], np.int32)
        place = np.full(1 << BITS, -1, np.int32)
        place[names] = np.arange(len(names))
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                doc, bucket = _hashed(part.column(0).to_pylist())
                doc, bucket = _distinct(doc[place[bucket] >= 0], bucket[place[bucket] >= 0])
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                at = [place[bucket[x:y]].tobytes() for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array(at, pa.binary())], names=["h", "y", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, at = [], []
        for batch in batches:
            y += batch.column(1).to_pylist()
            at += [np.frombuffer(x.as_py(), np.int32) for x in batch.column(2)]
        doc = np.repeat(np.arange(len(at)), [len(x) for x in at])
        weights, bias = fit_weights(doc, np.concatenate(at), np.frombuffer(sent.value[1]), np.array(y, np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["w", "bias"])

    if not len(names):
        discard(rows)
        return *none, float(np.log(toxic / others))
    row = rows.mapInArrow(present, "h long, y int, at binary").repartition(1).sortWithinPartitions("h").mapInArrow(run, "w binary, bias double").first()
    discard(rows)
    return names, np.frombuffer(bytes(row.w), np.float32), row.bias


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row per row. Null and empty texts score as a text without features; repeated rows score alike; other
    columns are ignored; no rows give no rows."""
    small_batches(docs.sparkSession)
    names, weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((names.tobytes(), weights.tobytes()))  # 8 bytes for each of 2**BITS buckets at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = np.zeros(1 << BITS, np.float32)
        table[np.frombuffer(sent.value[0], np.int32)] = np.frombuffer(sent.value[1], np.float32)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_rows(part.column(1).to_pylist(), table, bias), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
