"""Approximate nearest neighbours by a hash-prefix forest.

Every tree hashes a vector to a long string of bits. Each symbol of the string comes from a random rotation of its own:
it names the axis, with its sign, that the rotated vector leans to most; the bits of the symbols follow one another. A
tree is the sorted array of all strings. A query descends to its place in each array, next to the strings with which
it shares the longest prefix. From there all trees ascend together, a bit at a time: a shorter prefix is a longer range
around the place. The ascent stops at the longest prefix whose ranges hold ``budget`` rows over all trees, and what
they hold is compared.

In Spark the arrays are one table, sorted by (tree, string) over range partitions, so that every entry has a rank. An
array is cut into blocks of ``budget`` ranks, each with a quarter of that beside it on either side. One pass finds, for
each query and tree, the range at every length of prefix; the sums give the length to stop at. A second pass takes
vectors (as floats) to the blocks and keeps the best of each range, the best of all trees are then compared in
full. A task holds a block, however many rows share a prefix.

Ranges are looked at whole. Where one reaches beyond what its block holds, many rows are so near each other that the
strings don't part them (a crowd of near copies): such a query isn't cut short but meets all rows, in blocks of rows and
of queries, which is exact. So does a query that is left with fewer than ``k`` neighbours. For all others, work is
``budget`` candidates a query, which grows with the two thirds' power of the rows (``budget_for``).

Equal vectors are one entry, whatever their number; their smallest ids stand for them in results.

The hash knows directions only, the inner product also lengths. So rows are split into bands of like length, each with
arrays and a stop of its own, and a query descends those of every band. Within a band, the rows of largest inner
product are about those of like direction. Vectors of one length are one band.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphflow.llm._common import discard, folded, stored

BITS = 52  # of a string at most; numbers of so many bits are exact as doubles
LEAST = 12_000  # candidates of a query, over all trees and with repeats, up to 10,000 rows
ROWS, ASKED = 32_768, 4096  # rows and queries that meet in a block where queries meet all rows
SPARE = 12  # rows beyond k that are compared in full, since floats rank the others
BAND = 1.5  # ratio of lengths in a band, but for the ends of the quantiles that bound it


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (double): what takes part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(finite, F.lit(False)))


def _hash(rows: DataFrame, trees: int, dims: int, seed: int) -> DataFrame:
    """cid, band, asks, keys (the string of each tree as a long), unit (the vector, scaled to length 1, as floats)."""
    wide = max(1, (2 * dims - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rng = np.random.default_rng(seed)
        turn = [[np.linalg.qr(rng.normal(size=(dims, dims)))[0].astype(np.float32) for _ in range(max(1, BITS // wide))] for _ in range(trees)]
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
                top = np.abs(x).max(axis=1, keepdims=True)  # before the length, which may not be a number for such large ones
                x = x / top
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                keys, at = np.zeros((part.num_rows, trees), np.int64), np.arange(part.num_rows)
                for t in range(trees):
                    for r in turn[t]:
                        y = x @ r
                        best = np.abs(y).argmax(axis=1)
                        keys[:, t] = (keys[:, t] << wide) | best | ((y[at, best] < 0).astype(np.int64) << (wide - 1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, trees), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), flat, pa.array([v.tobytes() for v in x], pa.binary())], names=["cid", "band", "asks", "keys", "unit"])

    return rows.select("cid", "v", "band", "asks").mapInArrow(run, "cid long, band int, asks boolean, keys array<long>, unit binary")


def _length(v: Column) -> Column:
    top = F.array_max(F.transform(v, F.abs))
    return top * F.sqrt(F.aggregate(F.transform(v, lambda x: x / top), F.lit(0.0), lambda a, x: a + x * x))


def _bands(rows: DataFrame) -> tuple[Column, int]:
    """The band of a vector, 0 for the longest, and how many there are: bounded by quantiles, however far lengths lie apart."""
    at = [1.0] + [1 - 2.0**-j for j in range(20, 5, -1)] + [i / 32 for i in range(31, -1, -1)]
    quantiles = rows.select(_length(F.col("v")).alias("l")).agg(F.percentile_approx("l", at, 100_000)).first()[0]
    edges, top = [], quantiles[0]
    for q in quantiles[1:]:
        if q * BAND <= top:
            edges.append(q)
            top = q
    length, band = _length(F.col("v")), F.lit(0)
    for e in edges:
        band = band + (length < e).cast("int")
    return band, len(edges) + 1


def _arrays(strings: DataFrame, trees: int, bands: int) -> DataFrame:
    """tree, key, cid, asks, rank, n: every array, of ``n`` entries, in order; queries stand in those of all bands."""
    spread = strings.select("cid", "band", F.posexplode("keys").alias("t", "key"), "asks")
    held = spread.select((F.col("band") * trees + F.col("t")).alias("tree"), "key", "cid", F.lit(False).alias("asks"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    asked = spread.where("asks").select("t", "key", "cid", every.alias("b")).select((F.col("b") * trees + F.col("t")).alias("tree"), "key", "cid", F.lit(True).alias("asks"))
    order = ["tree", "key", "cid", "asks"]
    at = F.monotonically_increasing_id()
    entries = stored(held.union(asked).repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.shiftright(at, 33).alias("pid"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "arrays")
    spark, sizes = strings.sparkSession, lambda c: sorted(map(tuple, entries.groupBy(c).agg(F.count(F.lit(1))).collect()))  # as many rows as partitions, or arrays
    first, parts, own = 0, [], []
    for pid, n in sizes("pid"):
        parts.append((pid, first))
        first += n
    first = 0
    for tree, n in sizes("tree"):
        own.append((tree, first, n))
        first += n
    met = entries.join(F.broadcast(spark.createDataFrame(parts, "pid long, before long")), "pid").join(F.broadcast(spark.createDataFrame(own, "tree int, start long, n long")), "tree")
    out = met.select(*order, (F.col("before") + F.col("i") - F.col("start")).alias("rank"), "n")
    out._stored_at = entries._stored_at
    return out


def budget_for(rows: int) -> int:
    """Candidates of a query: with more rows, the nearest share shorter prefixes with it, and more others share those."""
    return max(LEAST, int(LEAST * (rows / 10_000) ** (2 / 3)))


def _blocks(arrays: DataFrame, block: int) -> DataFrame:
    """Adds block: queries go to their own, entries also to those they are beside of."""
    halo = block // 4
    near = F.sequence(F.floor(F.greatest(F.col("rank") - halo, F.lit(0)) / block), F.floor(F.least(F.col("rank") + halo, F.col("n") - 1) / block))
    home = F.array(F.floor(F.col("rank") / block))
    return arrays.withColumn("b", F.explode(F.when(F.col("asks"), home).otherwise(near))).withColumn("block", F.col("tree") * F.lit(1 << 32) + F.col("b")).drop("b")


def _sorted(group: pa.Table):
    """rank, key and cid of the entries, and those of the queries, of a block."""
    rank, key, cid, asks = (group.column(c).to_numpy() for c in ("rank", "key", "cid", "asks"))
    held, asked = (x[rank[x].argsort(kind="stable")] for x in ((~asks).nonzero()[0], asks.nonzero()[0]))
    return (rank[held], key[held], cid[held], held), (rank[asked], key[asked], cid[asked], asked)


def _matrix(group: pa.Table):
    """The vectors of the rows of a group, which is one chunk."""
    import numpy as np

    column = group.column("unit").chunk(0)
    to = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[to[0] : to[-1]].copy().view(np.float32).reshape(len(column), -1)


def _range(key, q, shift):
    """The entries whose strings agree with those of the queries but for the last ``shift`` bits."""
    import numpy as np

    low = (q >> shift) << shift
    return np.searchsorted(key, low), np.searchsorted(key, low + (np.int64(1) << shift))


def _stops(arrays: DataFrame, trees: int, bits: int, budget: int) -> DataFrame:
    """qid, band, stop: the longest prefix at which the ranges of a query hold enough, or 0."""

    def count(group: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np

        (rank, key, _, _), (r, q, qid, _) = _sorted(group)
        if not len(r):
            return
        out = np.zeros((len(r), bits + 1), np.int32)
        for length in range(bits + 1):
            lo, hi = _range(key, q, np.int64(bits - length))
            out[:, length] = hi - lo
        band = np.full(len(r), group.column("tree")[0].as_py() // trees, np.int32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, bits + 1), pa.int32()), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(band), flat], names=["qid", "band", "held"])

    def add(group: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = group.column("held").combine_chunks().flatten().to_numpy().reshape(-1, bits + 1)
        names = list(zip(group.column("qid").to_pylist(), group.column("band").to_pylist()))
        for qid, band in set(names):
            total = held[[x == (qid, band) for x in names]].sum(axis=0)
            enough = np.nonzero(total >= budget)[0]
            yield pa.RecordBatch.from_arrays([pa.array([qid], pa.int64()), pa.array([band], pa.int32()), pa.array([int(enough.max()) if len(enough) else 0], pa.int32())], names=["qid", "band", "stop"])

    counts = folded(_blocks(arrays, budget).select("block", "tree", "key", "cid", "asks", "rank"), "block", count, "qid long, band int, held array<int>")
    return folded(counts.select(F.xxhash64("qid", "band").alias("k"), "qid", "band", "held"), "k", add, "qid long, band int, stop int")


def _best(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """qid, cid, near: the best ``most`` of each query in each block (block, key, cid, asks, rank, n, stop, unit); a row
    without cid says that a range goes on beyond the block."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np

        (rank, key, cid, held), (r, q, qid, asked) = _sorted(group)
        if not len(r) or not len(rank):
            return
        unit = _matrix(group)
        length = group.column("length").to_numpy()[held]
        x, n = unit[held], group.column("n")[0].as_py()
        los, his = _range(key, q, bits - group.column("stop").to_numpy()[asked].astype(np.int64))
        beyond = ((los == 0) & (rank[0] > 0)) | ((his == len(rank)) & (rank[-1] < n - 1))
        who, other, near = [], [], []
        for i in np.nonzero(~beyond & (his > los))[0]:
            lo, hi = los[i], his[i]
            s = (x[lo:hi] @ unit[asked[i]]) * length[lo:hi]
            best = np.argpartition(-s, most)[:most] if len(s) > most else np.arange(len(s))
            who.append(np.full(len(best), qid[i]))
            other.append(cid[lo:hi][best])
            near.append(s[best].astype(np.float64))
        if who:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (who, other, near)], names=["qid", "cid", "near"])
        if beyond.any():
            ids = pa.array(np.unique(qid[beyond]))
            yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.float64())], names=["qid", "cid", "near"])

    best = folded(rows.select("block", "key", "cid", "asks", "rank", "n", "stop", "unit", "length"), "block", run, "qid long, cid long, near double")
    return best.groupBy("qid", "cid").agg(F.max("near").alias("near"))


def search(vectors: DataFrame, queries: Column, k: int = 20, trees: int = 48, budget: int | None = None, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each row that ``queries`` holds for.

    ``queries`` is a condition over vec_id. ``budget`` is the number of rows, counted over all trees and with repeats,
    that a query's ranges must hold before it stops ascending (in each band; by default ``budget_for`` the rows); with few
    rows everything is compared. Score is the inner product in double precision, summed in order of the components; ties
    go to the smaller vec_id, and a row is never its own neighbour. Vectors that are null, zero, of another length than
    most (ties: the longest) or hold null or non-finite components take no part, nor do rows without vec_id. Rows that
    repeat a vec_id with the same vector count once, with different vectors as their best. A query that ends with fewer
    than ``k`` neighbours, or is in a crowd that the strings don't part, meets all rows, in blocks. Other columns are
    ignored; no rows give no rows.
    """
    rows = _valid(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = lengths[0].n
    budget = budget_for(lengths[0].c) if budget is None else budget
    bits = (2 * dims - 1).bit_length() * max(1, BITS // max(1, (2 * dims - 1).bit_length()))
    rows = rows.where(F.size("v") == dims).distinct()
    asks = F.coalesce(F.max(queries), F.lit(False)).alias("asks")
    classes = stored(rows.groupBy("v").agg(asks).withColumn("cid", F.monotonically_increasing_id()), "vectors")
    members = stored(rows.join(classes.select("v", "cid").hint("merge"), "v").select("vec_id", "cid").distinct(), "members")
    band, bands = _bands(classes)
    strings = stored(_hash(classes.withColumn("band", band), trees, dims, seed), "strings")
    arrays = _arrays(strings, trees, bands)
    stops = stored(_stops(arrays, trees, bits, budget), "stops")

    lengths = classes.select("cid", _length(F.col("v")).alias("length")).hint("merge")
    vector = strings.select("cid", "unit").join(lengths, "cid")
    own = arrays.where("asks").withColumn("band", F.floor(F.col("tree") / trees).cast("int")).join(stops.select(F.col("qid").alias("cid"), "band", "stop").hint("merge"), ["cid", "band"]).drop("band")
    both = arrays.where("not asks").withColumn("stop", F.lit(0)).unionByName(own)
    met = stored(_best(_blocks(both, budget).join(vector.hint("merge"), "cid"), bits, k + SPARE), "met")
    crowded = met.where("cid is null").select("qid").distinct()
    near = stored(_first(met.where("cid is not null").join(crowded.hint("merge"), "qid", "left_anti"), k + SPARE), "near")
    discard(arrays, stops)

    # ranges count a row once for each tree, so few rows may fill them, or rows of one id: such queries meet all rows
    found = _expanded(near, classes, members, queries, k)
    others = members.agg(F.count_distinct("vec_id")).first()[0] - 1
    counts = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("found"))
    short = members.where(queries).join(counts.hint("merge"), "vec_id", "left").where(F.coalesce("found", F.lit(0)) < min(k, others))
    short = stored(short.select("cid").distinct(), "short")
    n = short.count()
    if n:
        whole = stored(_whole(short, n, strings.join(lengths, "cid"), _least(members, k), k), "whole")
        found = _expanded(near.join(short.withColumnRenamed("cid", "qid"), "qid", "left_anti").union(whole), classes, members, queries, k)
    return found.select("query_id", "rank", "vec_id", "score")


def _first(best: DataFrame, most: int) -> DataFrame:
    return best.withColumn("at", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("near"), "cid"))).where(F.col("at") <= most).select("qid", "cid")


def _least(members: DataFrame, k: int) -> DataFrame:
    """cid, vec_id: the smallest ids of equal vectors, as many as a result can hold."""
    return members.withColumn("at", F.row_number().over(W.partitionBy("cid").orderBy("vec_id"))).where(F.col("at") <= k + 1).select("cid", "vec_id")


def _whole(short: DataFrame, n: int, vectors: DataFrame, least: DataFrame, k: int) -> DataFrame:
    """qid, cid: for each of ``n`` queries the vectors of its nearest ids, by meeting every row in blocks."""
    chunks, blocks, most = -(-n // ASKED), -(-vectors.count() // ROWS), k + SPARE
    deal = lambda m, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.lit(m)).cast("long")
    upto = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    here = vectors.join(least.hint("merge"), "cid").select("cid", "vec_id", "unit", "length", deal(blocks, 5).alias("a"), upto(chunks).alias("b"))
    there = vectors.join(short.hint("merge"), "cid", "left_semi").select("cid", F.lit(None).cast("long").alias("vec_id"), "unit", "length", upto(blocks).alias("a"), deal(chunks, 6).alias("b"))
    rows = here.union(there).select((F.col("a") * chunks + F.col("b")).alias("block"), "cid", "vec_id", "unit", "length")

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np

        asks = group.column("vec_id").is_null().to_numpy()
        x = _matrix(group)
        cid, there, asked = group.column("cid").to_numpy(), x[~asks], np.nonzero(asks)[0]
        ids, length = (group.column(c).filter(pa.array(~asks)).to_numpy() for c in ("vec_id", "length"))
        if not len(there):
            return
        repeats = len(np.unique(ids)) < len(ids)  # an id may have several vectors
        for a in range(0, len(asked), 64):
            some = asked[a : a + 64]
            near, who, own, other = [], [], [], []
            for i, s in zip(some, (x[some] @ there.T) * length):
                if repeats:
                    order = np.argsort(-s, kind="stable")
                    best = order[np.sort(np.unique(ids[order], return_index=True)[1])[:most]]
                else:
                    best = np.argpartition(-s, most)[:most] if len(s) > most else np.arange(len(s))
                who.append(np.full(len(best), cid[i]))
                own.append(ids[best])
                other.append(cid[~asks][best])
                near.append(s[best].astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (who, own, other, near)], names=["qid", "vec_id", "cid", "near"])

    best = folded(rows, "block", run, "qid long, vec_id long, cid long, near double")
    one = best.groupBy("qid", "vec_id").agg(F.max(F.struct("near", "cid")).alias("m")).select("qid", "vec_id", "m.near", "m.cid")
    by = W.partitionBy("qid").orderBy(F.desc("near"), "vec_id")
    return one.withColumn("at", F.row_number().over(by)).where(F.col("at") <= most).select("qid", "cid").distinct()


def _expanded(near: DataFrame, classes: DataFrame, members: DataFrame, queries: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` among pairs of vectors (qid, cid), scored in full."""
    one, two = classes.select(F.col("cid").alias("qid"), F.col("v").alias("q")).hint("merge"), classes.select("cid", "v").hint("merge")
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = near.select("qid", "cid").join(one, "qid").join(two, "cid").select("qid", "cid", dot.alias("score"))
    asked = members.where(queries).select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid"))
    pairs = scored.join(_least(members, k).hint("merge"), "cid").join(asked.hint("merge"), "qid").where("query_id <> vec_id")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
