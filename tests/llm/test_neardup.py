import random
import re

import numpy as np
import pytest

from glyphflow.llm import neardup

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = SPLIT.findall((text or "").translate(ASCII))
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs, width):
    sets = {d: shingles(t, width) for d, t in docs}
    up = {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    for d in sets:
        both = {}
        for x in sets[d]:
            for e in where[x]:
                if e < d:
                    both[e] = both.get(e, 0) + 1
        for e, n in both.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def crowd(seed=5, n=400):
    """A crowd of near copies larger than a leaf, chains, exact copies and texts by themselves."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    texts = []
    for k in range(n):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for _ in range(30):
        chain[rnd.randrange(100)] = word()
        chain[rnd.randrange(100)] = word()
        texts.append("\t".join(chain).upper())
    texts += ["x y"] * 70 + ["one"] * 3 + ["", " \n", "X  Y", "y x", " "]
    texts += [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    rnd.shuffle(texts)
    return list(enumerate(texts, 10))


def test_against_brute_force(spark):
    docs = crowd()
    for width in (2, 5):
        got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'a' as fp", "2 as rep"), width).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, width)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_more_wanted_than_a_filter_takes(spark, monkeypatch):
    """Then rows meet the wanted ids in a join, and a filter of two bits lets all of them pass."""
    monkeypatch.setattr(neardup, "MOST_BITS", 3)
    docs = crowd()[:300]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 2)


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = neardup.near_duplicates(docs, 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute([(r.doc_id, r.text) for r in docs.collect()], 2)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(40000))
    rows = [(None, "a b c"), (1, None), (2, "a b c"), (3, "A B c"), (3, "A B c"), (4, long), (5, long + " end"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 2).collect()], key=str)
    assert got == sorted([(None, 2, None, True), (1, 0, 1, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (4, 39999, 4, True), (5, 40000, 4, False), (None, 0, None, True)], key=str)
    kept = neardup.deduplicate(df.selectExpr("doc_id", "text", "1 as n"), 2)
    assert kept.columns == ["doc_id", "text", "n"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 4]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_nodes(spark, monkeypatch):
    """With small leaves and blocks, nodes branch, crowds meet their few, and texts just below the threshold all over
    are compared in blocks; sets larger than a block are split over ranges."""
    for name, small in (("LEAF", 6), ("CROWD", 16), ("STAR", 3)):
        monkeypatch.setattr(neardup, name, small)
    rnd = random.Random(9)
    base = [f"t{i}" for i in range(200)]
    docs = crowd(3, 150)[:400]
    for k in range(120):  # of one template, at about 0.75 of each other
        w = list(base)
        for at in rnd.sample(range(200), 14):
            w[at] = f"x{k}y{at}"
        docs.append((1000 + k, " ".join(w)))
    depths = []
    branched = neardup._branched
    monkeypatch.setattr(neardup, "_branched", lambda *a: depths.append(a[-1]) or branched(*a))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 1)
    assert depths


def test_links_over_ranges():
    """Counting intersections range by range gives what sets give."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**64, 900_000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[: 900_000 - 40_000 * k], rng.integers(0, 2**64, 30_000 * k, dtype=np.uint64)])) for k in range(4)]
    want = [(i, j) for i in range(4) for j in range(i + 1, 4) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert 0 < len(want) < 6 and list(neardup._linked(sets, np.arange(4), (80, 100))) == want


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 500), (7, 7), (2000, 1500), (1500, 2000)]
    got = {r.rep: r.label for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 1000: 500, 1500: 1500, 2000: 1500}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_missed_pairs():
    """The miss of a descent, simulated level by level, is the one that trees are counted for."""
    rng = np.random.default_rng(4)
    n, j = 400_000, 0.8
    for depth in (1, 3):
        together = np.ones((n, 2**depth), bool)
        for _ in range(depth):
            together &= rng.random(together.shape) < j
            together = together[:, ::2] | together[:, 1::2]
        hit = (rng.random((n, 2)) < j).all(axis=1) & together[:, 0]
        assert abs((~hit).mean() - neardup.missed(1, (80, 100), depth)) < 0.003
    assert neardup.missed(3, (80, 100), 40) <= neardup.missed(3, (80, 100)) * (1 + 1e-9)
    assert neardup.missed(neardup.trees_for(0.99999, (80, 100)), (80, 100)) < 9e-6
    assert neardup.trees_for(0.999998, (80, 100)) > neardup.trees_for(0.99999, (80, 100))
    with pytest.raises(ValueError):
        neardup.trees_for(1.0, (80, 100))
