import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontam, test_neardup, test_pii


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    odd = [(-1, None), (-2, ""), (-3, "123 456"), (-4, "mail x@y.zz the end of the thing"), (-5, "the and of to in " * 1000)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'src0' as source", "cast(length(text) as bigint) as n_chars"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        found = out.collect()
        if name == "language_id":
            want = {k: v for k, v in rows.items() if v and any(c.isalpha() for c in v)}
        elif name == "near_dedup":
            keep = {d for d, (_, c) in test_neardup.brute(list(rows.items()), 5).items() if d == c}
            want = {k: v for k, v in rows.items() if k in keep}
        elif name == "decontamination":
            bad = {d for d, *_, c in test_decontam.brute(list(rows.items()), bench) if c}
            assert bad
            want = {k: v for k, v in rows.items() if k not in bad}
        elif name == "pii":
            got = {r.doc_id: r for r in found}
            assert set(got) == set(rows) and out.columns == docs.columns
            assert all(got[k].text == v for k, v in rows.items() if not any(c.isdigit() or c == "@" for c in v))
            assert all(not test_pii.brute(r.text) for r in got.values()) and got[-4].text == "mail [EMAIL] the end of the thing"
            assert all(r.n_chars == len(r.text) for r in got.values())
            want = {k: r.text for k, r in got.items()}
        else:
            slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            by = {}
            for r in found:
                by.setdefault(r.doc_id, []).append((r.start, list(np.frombuffer(r.ids, "<u4"))))
            assert {d: [int(x) for _, p in sorted(ps) for x in p] for d, ps in by.items()} == {d: slow.encode(t, add_special_tokens=False).ids + [1] for d, t in rows.items()}
            continue
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert {r.doc_id: r.text for r in found} == want, name
        rows, docs = want, spark.createDataFrame(found, docs.schema)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, ties, repeated rows, very long texts, clashing names and no rows at all pass through every stage."""
    sf = "/root/testdata/sf0.001"
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = " ".join(f"the and of in to word{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " end"), (3, long), (3, long), (None, "the of and in to a text without an id"), (4, None), (5, ""), (6, bench[0][1]), (7, "the of and in to " * 3000 + bench[0][1]), (8, "mail a@b.cc of the and in to"), (9, "the of and \U0001f600 in to"), (9, "the of and \U0001f600 in to")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, rep long, hits string, _w int, h string"
    docs = spark.createDataFrame([(i, t, "en" if i != 9 else None, None, len(t or ""), 1, "x", 2, "y") for i, t in rows], kinds)
    known = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", "cast(1 as bigint) as rep", "'x' as hits", "2 as _w", "'y' as h")
    whole, none = docs.unionByName(known), docs.limit(0)
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, whole, sf)
        out.write.parquet(str(tmp_path / str(at)))
        assert stage(spark, none, sf).collect() == []
        if at < 4:
            assert out.schema.simpleString() == whole.schema.simpleString()
            whole = spark.read.parquet(str(tmp_path / str(at)))
    left = {r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).where("doc_id < 1000 or doc_id is null").collect()}
    assert left == {1, None, 7, 8, 9}  # 2 and 3 copy 1; 4 and 5 have no words; 6 is a benchmark item, of 7 a small share is
    pieces = spark.read.parquet(str(tmp_path / "4"))
    assert pieces.agg({"length": "max"}).first()[0] <= 2048 and {r.doc_id for r in pieces.select("doc_id").distinct().collect()} >= left


def test_stages_leave_one_table(spark):
    """Of all that the stages store, the run leaves what its result is read from."""
    from glyphflow.llm import _common

    before = _common.standing()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = [p for p in _common.standing() if p not in before]
    assert len(left) == 1 and "stage-pii" in left[0] and out.count() > 0
