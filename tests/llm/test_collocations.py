import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.llm import collocations, queries
from tests.oracle import compare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows, least, most=2000, within=100):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        gone = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and 100 * a >= within * counts[p[i:j]]}
        found = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def test_query(spark):
    compare(spark, "/root/testdata/sf0.01", queries.op13_collocations, queries.OP13_SQL)


@pytest.mark.parametrize("width", [1 << 16, 64])
def test_random_texts(spark, monkeypatch, width):
    """A sketch in which everything collides rules nothing out and loses nothing either; small slices change nothing."""
    monkeypatch.setattr(collocations, "BLOCK", 16)
    monkeypatch.setattr(collocations, "SLICE", 300)
    rnd = random.Random(1)
    vocabulary = ["a", "B", "ce", "é", "ÉE", "x-y", "日本", "the", "of"]
    text = lambda: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "  ", "\t", " \t ", ", ", ".", "\n", "\x0b", "! ", "\xa0"]) for _ in range(rnd.randrange(60)))
    rows = [(text(), rnd.choice(["en", "en", "fr", None])) for _ in range(150)] + [("The of A " * 40, "en")] * 3 + [(None, "en"), ("", None), (" .,; ", "de"), ("x" * 5000, "en"), ("a " * 9000, "xx")]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as phrase", "2 as n", "3 as words", "4 as f")
    assert got(collocations.mine(df, least=4, width=width)) == exact(rows, 4)
    assert got(collocations.mine(df, least=9, most=3, within=60, width=width)) == exact(rows, 9, 3, 60)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(df).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("...", "en")], "text string, lang string")).collect() == []


def test_large_numbers(spark):
    """Products beyond 64 bits are exact."""
    rows = [("en", "", 0, 9_000_000_000_000), ("en", "a", 1, 4_000_000_000_007), ("en", "b", 1, 3_000_000_000_001), ("en", "a b", 2, 2_999_999_999_999)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    found = collocations._scored(counts, 100).first()
    assert found.score == 1000 * 2_999_999_999_999 * 9_000_000_000_000 // (4_000_000_000_007 * 3_000_000_000_001)


def test_sketch_rules_out(spark):
    """Of many rare phrases few get past a sketch of the usual width, and every frequent one does."""
    docs = spark.range(3000).select(F.concat_ws(" ", *(F.concat(F.lit(f"w{i}"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5000))) for i in range(12)), F.lit("new york")).alias("text"), F.lit("en").alias("lang"))
    width = collocations.width_for(400_000, 100)
    pairs = collocations._sketch(docs, width, 100)
    found = collocations._survivors(docs, pairs, collocations._sketch(docs, width, 100, pairs), width).where("words > 0").groupBy("phrase").agg(F.sum("f").alias("f")).collect()
    assert {r.phrase: r.f for r in found if r.f >= 100} == {"new": 3000, "york": 3000, "new york": 3000}
    assert len(found) < 1000


def test_blocks_come_back():
    for kind in ("u1", "<u4"):
        for block in (np.zeros(256, kind), np.arange(256).astype(kind), (np.arange(256) % 50 == 3).astype(kind) * 7):
            data = collocations._packed(block, kind)
            assert (collocations._unpacked(data, kind, 256) == block).all() and len(data) <= 1 + block.nbytes


def test_hashes_do_not_depend_on_the_array():
    import pyarrow as pa

    words = pa.array(["b", "", "abc", "é", "cba"])
    assert (collocations._hashes(words)[1:4] == collocations._hashes(words.slice(1, 3))).all()
    assert len(set(collocations._hashes(words).tolist())) == 5 and collocations._hashes(words).dtype == np.uint64


def test_a_task_sums_its_slices(spark):
    """Three slices of text in a task leave one row a phrase, not three; and more partitions than cores take aren't kept."""
    text = "a b c d. " * 12_000
    docs = spark.range(0, 200, 1, 1).select(F.lit(text).alias("text"), F.lit("en").alias("lang"))
    bits = np.full(collocations.DEPTH * collocations.BLOCK // 8, 255, np.uint8)
    rows = [tuple(r) for r in collocations._survivors(docs, bits, bits, collocations.BLOCK).collect()]
    phrases = [" ".join("abcd"[i:j]) for i in range(4) for j in range(i + 1, 5)]
    n = 200 * 12_000
    assert sorted(rows) == sorted([("en", "", 0, 4 * n), *(("en", p, len(p.split()), n) for p in phrases)])
    most = 2 * spark.sparkContext.defaultParallelism
    assert collocations._dealt(docs.repartition(5 * most)).rdd.getNumPartitions() == most


def test_sums_are_sent_on_before_they_grow(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "HELD", 20)
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "phrase": ["a", "b", f"c{k}"], "words": pa.array([1] * 3, pa.int32()), "f": [1, 2, 3]}) for k in range(40)]
    out = list(collocations._summed(iter(batches)))
    sums = pa.Table.from_batches(out).to_pandas().groupby("phrase").f.sum().to_dict()
    assert sums == {"a": 40, "b": 80} | {f"c{k}": 3 for k in range(40)}
    assert max(b.num_rows for b in out) < 20 + 3 and sum(b.num_rows for b in out) < 100
