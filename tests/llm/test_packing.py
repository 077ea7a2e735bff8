import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphflow.llm.packing import best_fit_decreasing, encoder, pack

FILE = public_tokenizers.path("byte_bpe_50k.json")


def slow_best_fit(lengths, capacity):
    rooms, where = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r[0] >= lengths[i]]
        if fits:
            best = min(fits, key=lambda r: r[0])
        else:
            best = [capacity, len(rooms)]
            rooms.append(best)
        best[0] -= lengths[i]
        where[i] = best[1]
    return where, sorted(r[0] for r in rooms)


@given(st.lists(st.integers(1, 17), max_size=60))
def test_tightest_window(lengths):
    where, offset, n = best_fit_decreasing(lengths, 17)
    _, rooms = slow_best_fit(lengths, 17)
    filled = [0] * n
    for w, size in zip(where, lengths):
        filled[w] += size
    assert sorted(17 - f for f in filled) == rooms
    for w in range(n):
        spans = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if where[i] == w)
        at = 0
        for start, size in spans:
            assert start == at
            at += size
        assert at <= 17


def test_both_engines_agree():
    random.seed(3)
    slow = Tokenizer.from_file(FILE)
    texts = ["".join(chr(random.choice([32, 10, 160, 133, 28, 39, random.randrange(256)])) for _ in range(60)) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "don't I'll  x", "", "日本語 text", "Ⅷ ½ ²³ ª", "x" * 5000, "​　  a"]
    assert encoder(FILE)(texts) == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def test_every_id_in_one_piece(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, None, "x"), (-1, "", "x"), (-2, "same", "x"), (-2, "same", "x"), (-3, "word " * 30000, "x")], docs.schema)
    texts = [(r.doc_id, r.text) for r in docs.union(odd).collect()]
    rows = pack(docs.union(odd).withColumnRenamed("lang", "start"), FILE, batch_tokens=50_000).collect()
    slow = Tokenizer.from_file(FILE)
    want = sorted(str((d, slow.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in texts if d != -2)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) // 4 <= 2048
    got = [str((d, [int(x) for p in sorted(ps, key=lambda p: p.start) for x in np.frombuffer(p.ids, "<u4")])) for d, ps in by.items() if d != -2]
    assert sorted(got) == want and len(by[-2]) == 2
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for start, size in sorted(spans):
            assert start == at
            at += size
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(used) * 2048 < total * 1.1


def test_empty_table_and_checksum(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, FILE).collect() == []
    row = pack(spark.createDataFrame([(7, "hello")], "doc_id long, text string"), FILE).selectExpr("crc32(ids) c", "ids").first()
    assert row.c == zlib.crc32(bytes(row.ids))


def test_query_against_brute_force(spark):
    """Every column of the query on the whole table: ids by the plain tokenizer, pieces without gap or overlap."""
    from glyphflow.llm import queries

    sf = "/root/testdata/sf0.01"
    slow = Tokenizer.from_file(FILE)
    want = {r.doc_id: np.array(slow.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_packing(spark, sf).collect()
    held, used = {}, {}
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        held.setdefault(r.doc_id, []).append((r.start, r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, total in [*((held[d], len(ids)) for d, ids in want.items()), *((s, None) for s in used.values())]:
        at = 0
        for start, size in sorted(spans):
            assert start == at
            at += size
        assert at == total or (total is None and at <= 2048)
    assert len(used) * 2048 < 1.02 * sum(r.length for r in rows) + 8 * 2048  # a task may leave its last window partly empty


def test_stored_tables_are_discarded(spark):
    from glyphflow.llm import _common

    df = _common.stored(spark.range(3).toDF("x"), "kept")
    assert df.count() == 3 and df._stored_at in _common._left
    _common.discard(df, None)
    assert df._stored_at not in _common._left
