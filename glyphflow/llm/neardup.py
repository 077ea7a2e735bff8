"""Near duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Trees are independent: each has minwise functions of its own at
every level. The root takes two tokens at once, so that sets with one common shingle don't meet; below it, a node
branches on two tokens that its tree and level choose, and sets with the same value go to the same child. Sets of
Jaccard similarity 0.8 share each value with probability 0.8, sets of little in common hardly ever. A node of at most
``LEAF`` sets compares them exhaustively; larger ones branch on. With q the chance that a pair stays together
somewhere below a node, a level more makes it 1 - (1 - 0.8 q)^2, which never falls below 0.9375 however deep the tree
goes, so a tree finds a pair at the threshold with probability 0.64 * 0.9375 = 0.6 at least. ``trees_for`` counts the
trees for the recall asked with that bound.

Order of work, all of it in DataFrames over shuffles:

1. Equal sets collapse into one class, named by its smallest doc_id, so exact copies cost one row each.
2. Each set is compared with the leaders (smallest ids) of its root nodes, and verified against the first of them that
   sketches allow. Most of a crowd of near copies joins its leader so, by as many comparisons as it has members. The
   leader is the set's label; sets of one label need not meet again.
3. Nodes of one label are done. Others of at most ``LEAF`` sets are compared in full. In a larger one, the most
   frequent label is the crowd; if at most ``LEAF`` sets are outside it, they meet the crowd in blocks. Else the node
   branches on, with tokens that are computed for its sets alone, as long as a level lowers the number of pairs left;
   what it doesn't lower (texts just below the threshold all over) is compared in blocks, exactly.
4. Comparing means sketches first (a byte each of 64 more minwise values); sets that may reach the threshold are
   fetched and compared exactly, on whole sets. Blocks bound what a task holds, not what is compared.
5. Components come from contracting the verified links until none is left.

Sketches pass a pair from 34 of 64 equal bytes on (a true pair at 0.8 misses that with probability 1e-6).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm._common import discard, folded, shared_dir, small_batches, stored

SKETCH, SKETCH_MIN = 64, 34
SKETCH_MISS = 1e-6
LEAF, CROWD, STAR = 512, 512, 47  # sets of a leaf; of a block of a crowd; of a block that meets its leader
#: Shingles that a block holds, unless two sets alone have more.
BLOCK_SHINGLES = 4_000_000
#: Bits of the filter that tells which sets to fetch: eight for each wanted text, so one in nine others passes; 8 MB as it
#: travels at most. For more wanted texts than that is made for, rows meet the wanted ids in a join before.
LEAST_BITS, MOST_BITS = 20, 26

_words: dict[bytes, int] = {}


def shingle_hashes(text: str | None, width: int):
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, an empty one has none."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; splits at space and 09-0D
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > 200_000:
        _words.clear()
    hashes = []
    for w in words:
        h = _words.get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    k = min(width, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - k + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(31)))


def _functions(count: int, seed: int):
    """Odd factors and summands of minwise functions."""
    import numpy as np

    rng = np.random.default_rng([20240229, seed])
    return rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def _minima(shingles, mul, add):
    """The 32-bit minwise value of each function."""
    import numpy as np

    low = np.full(len(mul), 2**32 - 1, np.uint64)
    for b in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[b : b + 4096, None] * mul + add) >> np.uint64(32)).min(axis=0))
    return low


def _shingled(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """doc_id, n, fp (of the set; null if empty), tokens (two for each root), sketch."""
    count = 2 * trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        mul, add = _functions(count + SKETCH, 0)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(ids), 512):
                n, fp, tokens, sketch = [], [], [], []
                for text in texts.slice(a, 512):
                    s = shingle_hashes(text.as_py(), width)
                    n.append(len(s))
                    if not len(s):
                        fp.append(None), tokens.append(None), sketch.append(None)
                        continue
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    low = _minima(s, mul, add)
                    tokens.append(low[:count].astype(np.uint32).view(np.int32))
                    sketch.append(((low[count:] * np.uint64(0x9E3779B1)) >> np.uint64(24)).astype(np.uint8).tobytes())
                cols = [ids.slice(a, 512), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "fp", "tokens", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, fp binary, tokens array<int>, sketch binary")


def _fetched(docs: DataFrame, wanted: DataFrame, width: int, made: Callable, kind: pa.DataType, schema: str) -> DataFrame:
    """A row (rep, n, made of its shingles) for each text of a wanted set, and for few others; each once.

    Texts stay where they are: a filter of the wanted ids goes to them, and only what passes is sent on. Very many wanted
    texts are joined with by id instead.
    """
    import numpy as np

    asked = wanted.agg(F.approx_count_distinct("rep")).first()[0]
    joined = 8 * asked > 1 << MOST_BITS
    size = 1 << (1 if joined else max(LEAST_BITS, min(MOST_BITS, (8 * asked).bit_length())))
    place = F.pmod(F.xxhash64("rep"), F.lit(size))
    cells = wanted.select(place.alias("at")).selectExpr("cast(floor(at / 62) as int) as cell", "shiftleft(1L, cast(at % 62 as int)) as bit").groupBy("cell").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    bits = np.zeros((size - 1) // 62 + 1, np.int64)
    bits[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.int64)
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = np.nonzero((bits[at // 62] >> (at % 62)) & 1)[0]
            for a in range(0, len(hit), 128):
                part = batch.take(pa.array(hit[a : a + 128]))
                sets = [shingle_hashes(t.as_py(), width) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([made(x) for x in sets], kind)], names=["rep", "n", "made"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text")
    if joined:
        rows = rows.join(wanted.select("rep").distinct().hint("merge"), "rep", "left_semi")
    rows = rows.select("rep", "text", place.alias("at"))
    found = rows.mapInArrow(run, f"rep long, n long, made {schema}")
    return found.repartition("rep").groupBy("rep", "n", F.xxhash64("made").alias("h")).agg(F.first("made").alias("made")).drop("h")


def _merge(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join whose sides may grow with the input: shuffled, a hot key being split at run time, unless a stored side is
    smaller than the session's bound for broadcasts, when nothing is shuffled."""
    return left.join(right, on, how)


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _sketches(column):
    import numpy as np

    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(-1, SKETCH)


def _likely(sketch, n, label, share: tuple[int, int]):
    """Pairs of positions of different labels whose sketches and sizes allow the threshold."""
    import numpy as np

    found = []
    for a in range(0, len(n), 64):
        ok = label[a : a + 64, None] != label[None, :]
        ok &= share[1] * np.minimum(n[a : a + 64, None], n[None, :]) >= share[0] * np.maximum(n[a : a + 64, None], n[None, :])
        ok &= np.arange(a, min(a + 64, len(n)))[:, None] < np.arange(len(n))[None, :]
        i, j = np.nonzero(ok)
        for b in range(0, len(i), 65536):
            x, y = i[b : b + 65536] + a, j[b : b + 65536]
            same = (sketch[x] == sketch[y]).sum(axis=1) >= SKETCH_MIN
            found.append(np.stack([x[same], y[same]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _linked(sets: list, label, share: tuple[int, int]):
    """Pairs of positions of different labels that full sets link. Intersections are counted for all pairs at once,
    range by range of the hashes, so that memory is bounded however large the sets are."""
    import numpy as np

    k = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    both = np.zeros((k, k), np.int64)
    ranges = max(1, -(-int(size.sum()) // 1_000_000))
    cuts = [np.uint64(2**64 * r // ranges) for r in range(1, ranges)]
    at = [np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]]).astype(np.int64) for x in sets]
    for r in range(ranges):
        parts = [x[p[r] : p[r + 1]] for x, p in zip(sets, at)]
        _, column, held = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(k), [len(x) for x in parts])
        shared = held[column] > 1  # a shingle of one set alone is in no intersection
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            lo, hi = np.searchsorted(column, (a, a + 8192))
            part = np.zeros((k, 8192), np.float32)
            part[row[lo:hi], column[lo:hi] - a] = 1
            both += (part @ part.T).astype(np.int64)
    ok = (share[1] * both >= share[0] * (size[:, None] + size[None, :] - both)) & (label[:, None] != label[None, :])
    i, j = np.nonzero(np.triu(ok, 1))
    return zip(i.tolist(), j.tolist())


def _clusters(groups: DataFrame, share: tuple[int, int]) -> DataFrame:
    """cluster, rep, label, n: what of each group (g, rep, n, sketch, label) may hold new links; each cluster once."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        rep, n, label = (group.column(c).to_numpy() for c in ("rep", "n", "label"))
        pairs = _likely(_sketches(group.column("sketch")), n, label, share)
        if not len(pairs):
            return
        sets = _Sets(len(rep))
        for i, j in pairs.tolist():
            sets.join(i, j)
        found: dict[int, list[int]] = {}
        for i in np.unique(pairs).tolist():
            found.setdefault(sets.root(i), []).append(i)
        out: list[tuple[int, int]] = []
        for own in found.values():
            own.sort(key=lambda i: (rep[i], label[i], n[i]))
            blocks, room = [[]], BLOCK_SHINGLES // 2
            for i in own:  # blocks meet two by two, so each pair of sets does
                if blocks[-1] and n[i] > room:
                    blocks.append([])
                    room = BLOCK_SHINGLES // 2
                blocks[-1].append(i)
                room -= n[i]
            parts = [own] if len(blocks) == 1 else [x + y for k, x in enumerate(blocks) for y in blocks[k + 1 :]]
            for part in parts:
                name = xxhash.xxh3_64_intdigest(np.stack([rep[part], label[part], n[part]]).astype(np.int64).tobytes()) - 2**63
                out += [(name, i) for i in part]
        at = [i for _, i in out]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array(rep[at]), pa.array(label[at]), pa.array(n[at])], names=["cluster", "rep", "label", "n"])

    return folded(groups.select("g", "rep", "n", "sketch", "label"), "g", run, "cluster long, rep long, label long, n long").distinct()


def _links(clusters: DataFrame, docs: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """a, b: for each cluster (cluster, rep, label, n), as far as verified links on full sets join it, the smallest rep
    and each other one."""
    sets = _fetched(docs, clusters, width, lambda x: x.tobytes(), pa.binary(), "binary")
    met = clusters.join(sets.hint("merge"), ["rep", "n"]).select("cluster", "rep", "label", "made")

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rep, label = group.column("rep").to_numpy(), group.column("label").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("made")]
        joined = _Sets(len(rep))
        for i, j in _linked(sets, label, share) if len(rep) > 1 else ():
            joined.join(i, j)
        least: dict[int, int] = {}
        for i in range(len(rep)):
            least[joined.root(i)] = min(rep[i], least.get(joined.root(i), rep[i]))
        pairs = sorted({(int(least[joined.root(i)]), int(rep[i])) for i in range(len(rep)) if least[joined.root(i)] != rep[i]})
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return folded(met, "cluster", run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """rep, label: for every end of a link (a, b), the smallest end that it reaches. No links give no rows.

    Each round sends every end to the least of itself and its neighbours and contracts the links accordingly, until
    none is left. After the first round, "least" goes by a hash that changes with the round, so a long chain in order
    of its ids takes logarithmically many rounds too.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    names, turn = None, 0
    while not links.isEmpty():
        rank = (lambda c: F.col(c)) if turn == 0 else (lambda c, k=turn: F.xxhash64(c, F.lit(k)))
        both = links.union(links.select("b", "a"))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("m"))
        to = stored(near.select("v", F.when(F.col("m.r") < rank("v"), F.col("m.to")).otherwise(F.col("v")).alias("to")), "sent")
        if names is None:  # every end is its own name before the first round
            moved = to.select(F.col("v").alias("rep"), F.col("to").alias("at"))
        else:
            moved = _merge(names, to.withColumnRenamed("v", "at"), "at", "left").select("rep", F.coalesce("to", "at").alias("at"))
        ends = _merge(links, to.withColumnRenamed("v", "a"), "a").select(F.col("to").alias("x"), "b")
        ends = _merge(ends, to.withColumnRenamed("v", "b"), "b").select("x", F.col("to").alias("y"))
        left = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        held = stored(moved, "names")
        discard(links, to, *([] if names is None else [names]))
        links, names, turn = left, held, turn + 1
    if names is None:
        return links.select(F.col("a").alias("rep"), F.col("b").alias("label"))
    discard(links)
    least = stored(names.groupBy("at").agg(F.min("rep").alias("label")), "least")
    return _merge(names, least, "at").select("rep", "label")


def missed(trees: int, share: tuple[int, int], depth: int | None = None) -> float:
    """The probability that a pair at the threshold meets in no tree, if nodes branch ``depth`` times below the root,
    or however often. Trees and levels have functions of their own, so it is a product."""
    j = share[0] / share[1]
    q, level = 1.0, 0
    while level != depth:
        q, last = 1 - (1 - j * q) ** 2, q
        level += 1
        if last - q < 1e-12:
            break
    return (1 - j * j * q) ** trees


def trees_for(recall: float, share: tuple[int, int]) -> int:
    """Trees for which a pair at the threshold is missed with 1 - recall at most, sketches included."""
    for trees in range(1, 1001):
        if missed(trees, share) + SKETCH_MISS <= 1 - recall:
            return trees
    raise ValueError(f"no number of trees up to 1000 has recall {recall}")


def _sized(paths: DataFrame) -> DataFrame:
    """Nodes (node, size, leader) of at least two sets."""
    return paths.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("leader")).where("size > 1")


def _first_leaders(paths: DataFrame, classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """rep, leader: the first leader of a node that sketches and sizes let the set be linked with, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            a, b = _sketches(batch.column(2)), _sketches(batch.column(3))
            n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            ok = ((a == b).sum(axis=1) >= SKETCH_MIN) & (share[1] * np.minimum(n, m) >= share[0] * np.maximum(n, m))
            yield batch.select([0, 1]).filter(pa.array(ok))

    pairs = paths.where("rep <> leader").select("leader", "rep").distinct()
    own, other = classes.select("rep", "n", "sketch"), classes.select(F.col("rep").alias("leader"), F.col("n").alias("m"), F.col("sketch").alias("s"))
    rows = _merge(_merge(pairs, own, "rep"), other, "leader").select("rep", "leader", "sketch", "s", "n", "m")
    return rows.mapInArrow(run, "rep long, leader long").groupBy("rep").agg(F.min("leader").alias("leader"))


def _branched(rows: DataFrame, docs: DataFrame, width: int, trees: int, depth: int) -> DataFrame:
    """rep, node: the children of the nodes (node, tree, rep) on two tokens that their tree takes at this depth."""
    count = 2 * trees

    def tokens(shingles):
        import numpy as np

        return _minima(shingles, *_functions(count, depth)).astype(np.uint32).view(np.int32).tolist() if len(shingles) else [0] * count

    own = _fetched(docs, rows.select("rep"), width, tokens, pa.list_(pa.int32()), "array<int>").select("rep", F.col("made").alias("tokens"))
    at = lambda k: F.get("tokens", 2 * F.col("tree") + k)
    child = F.array(*[F.xxhash64("node", F.lit(k), at(k)) for k in (0, 1)])
    return _merge(rows, own, "rep").select("rep", "tree", F.explode(child).alias("node")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Words are what stands between spaces and U+0009 to U+000D, with A-Z lower-cased. Two documents are linked if
    ``share[1] * |both| >= share[0] * |either|``; component_id is the smallest doc_id that links reach, and kept says
    that it is the document's own. Null, empty and blank texts have no shingles, are linked with nothing and kept.
    A text of fewer words than ``width`` is one shingle. Rows of one doc_id are one document with several texts. A
    row without doc_id takes no part: its component_id is null and it is kept. No rows give no rows; other columns
    are ignored.
    """
    shared_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    trees = trees_for(recall, share)
    sets = stored(_shingled(docs, width, trees), "sets")
    known = sets.where("fp is not null and doc_id is not null")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "classes")
    roots = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.get("tokens", F.lit(2 * t)), F.get("tokens", F.lit(2 * t + 1))).alias("node")) for t in range(trees)])
    paths = classes.select("rep", F.explode(roots).alias("r")).select("rep", "r.tree", "r.node")
    sizes = stored(_sized(paths), "sizes")  # a table of its own, so that the join can split a hot node
    rows = stored(_merge(paths, sizes, "node"), "paths")
    tables = [sizes, rows]

    # each set against the first likely leader of its nodes; what is verified is its label
    first = stored(_first_leaders(rows, classes, share), "first")
    crowd = stored(first.groupBy("leader").agg(F.count(F.lit(1)).alias("size")), "crowds")
    block = F.pmod(F.xxhash64("rep", F.lit(7)), F.ceil(F.col("size") / STAR).cast("int"))
    star = stored(_merge(first, crowd, "leader").select("leader", "rep", F.xxhash64("leader", block).alias("cluster")), "leaders")
    both = star.select("cluster", "rep").union(star.select("cluster", F.col("leader").alias("rep")).distinct())
    stars = stored(_links(_merge(both, classes.select("rep", "n"), "rep").select("cluster", "rep", F.col("rep").alias("label"), "n"), docs, width, share), "stars")
    labels = stored(_labelled(stars), "labels")

    groups, crowds, left, depth = [], [], None, 0
    tables += [first, crowd, star, stars, labels]
    rows = _merge(rows, labels, "rep", "left").select("node", "tree", "rep", F.coalesce("label", "rep").alias("label"))
    while True:
        # the most frequent label of each node, and how many sets lie outside it
        per = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("own"))
        top = per.groupBy("node").agg(F.max(F.struct("own", "label")).alias("top"), F.sum("own").alias("size")).select("node", F.col("top.label").alias("main"), "size", (F.col("size") - F.col("top.own")).alias("others")).where("others > 0")
        top = stored(top, "mains")
        held = stored(_merge(rows, top, "node"), f"nodes{depth}")
        tables += [top, held]
        groups.append(held.where(F.col("size") <= LEAF).select(F.col("node").alias("g"), "rep", "label"))
        large = held.where(F.col("size") > LEAF)
        sums = large.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("others") > LEAF, F.col("others"))).alias("pairs")).first()
        if not sums.rows:
            break
        on = F.col("others") > LEAF
        pays = sums.pairs is not None and (left is None or sums.pairs < 0.9 * left)
        crowds.append((large.where(~on) if pays else large).select("main", "rep", "label"))
        if not pays:
            break
        left, depth = sums.pairs, depth + 1
        named = large.where(on).select("node", "tree", "rep", "label")
        rows = _branched(named, docs, width, trees, depth)
        rows = _merge(_merge(rows, _sized(rows).select("node"), "node"), named.select("rep", "label").distinct(), "rep")
    met = groups[0]
    for more in groups[1:]:
        met = met.union(more)
    if crowds:
        crowd = crowds[0]
        for more in crowds[1:]:
            crowd = crowd.union(more)
        # nodes of all trees with one main label are one crowd, whose few meet all of it once
        crowd = stored(crowd.select("main", "rep", "label", (F.col("label") != F.col("main")).alias("few")).distinct(), "crowd")
        sizes = stored(crowd.groupBy("main").agg(F.count(F.lit(1)).alias("size"), F.count_if("few").alias("others")), "sizes")
        tables += [crowd, sizes]
        deal = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.ceil(F.col(n) / CROWD)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / CROWD) - 1).cast("int")))
        crowd = _merge(crowd, sizes, "main")
        blocks = crowd.select("main", "rep", "label", deal("size", 7).alias("block"), every("others").alias("chunk")).union(crowd.where("few").select("main", "rep", "label", every("size").alias("block"), deal("others", 11).alias("chunk")))
        met = met.union(blocks.select(F.xxhash64("main", "block", "chunk").alias("g"), "rep", "label").distinct())
    clusters = stored(_clusters(_merge(met, classes.select("rep", "n", "sketch"), "rep"), share), "clusters")
    tables.append(clusters)
    named = stored(components(_links(clusters, docs, width, share).union(stars)), "components")
    discard(*tables)
    names = _merge(classes.select("fp", "rep"), named, "rep", "left").select("fp", F.coalesce("label", "rep").alias("component"))
    out = _merge(sets.select("doc_id", "n", "fp"), names, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _labelled(stars: DataFrame) -> DataFrame:
    """rep, label: of sets that a verified link joins to a smaller one, the smallest."""
    return stars.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("label"))


def deduplicate(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, columns as they are; rows without doc_id stay."""
    found = near_duplicates(docs, width, share, recall, id_col, text_col)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
