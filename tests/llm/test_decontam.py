import re

import pytest

from glyphflow.llm import decontam, queries
from tests.oracle import compare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(ASCII))


def brute(docs, bench, width=13):
    wins = {}
    for item, t in bench:
        w = words(t)
        for i in range(max(len(w) - width + 1, 1 if w else 0)):
            wins.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    items |= wins[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(20))
BENCH = [(1, LONG), (2, "Short item"), (3, None), (4, "..."), (5, "Éa single"), (6, LONG), (None, "odd one here")]
DOCS = [(1, f"x {LONG.upper()} y"), (2, None), (3, ""), (4, "a short, ITEM! short-item"), (5, "éa single"), (5, "éa single"), (6, "Éa\x7fsingle " + "z " * 400), (None, "odd one HERE"), (7, " ".join(f"w{i}" for i in range(12))), (8, "w0 " * 3000 + LONG), (9, LONG + " " + LONG)]


@pytest.mark.parametrize("bound", [20_000, 2])
def test_against_brute_force(spark, bound):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("doc_id", "text", "'q' as window", "1 as key")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontam.report(docs, bench, max_windows=bound).collect()
    want = [(d, n, h, [x for x in items if x != "None"], bad) for d, n, h, items, bad in brute(DOCS, BENCH)]  # an item without id hits, unnamed
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got], key=str) == want


def test_actions(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("doc_id", "text", "'q' as window", "1 as key")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    bad = {d for d, *_, c in brute(DOCS, BENCH) if c}
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in DOCS if d not in bad)
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, "spans").collect()}
    assert cut[1] == "x y" and cut[4] == "a" and cut[2] is None and cut[3] == "" and cut[7] == dict(DOCS)[7]


def test_actions_beyond_bound(spark):
    """A row goes by its own text: not with others of its doc_id, nor with others without one."""
    docs = [*DOCS, (None, "clean words"), (1, "clean words too"), (None, None), (9, LONG + " " + LONG)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'q' as window", "1 as key")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for action in ("documents", "spans"):
        few, many = (sorted(map(tuple, decontam.decontaminate(df, bench, action, max_windows=n).collect()), key=str) for n in (20_000, 2))
        assert few == many
    bad = {t for (_, t), r in zip(docs, [brute([d], BENCH)[0] for d in docs]) if r[-1]}
    kept = decontam.decontaminate(df, bench, max_windows=2)
    assert kept.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([d for d in docs if d[1] not in bad], key=str)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(docs, spark.createDataFrame(BENCH, "item_id long, text string")).collect() == []
    assert [r.n_hit for r in decontam.report(spark.createDataFrame(DOCS, "doc_id long, text string"), bench).collect()] == [0] * len(DOCS)


def test_query(spark, tiny):
    compare(spark, tiny, queries.op7_decontamination, queries.OP7_SQL)
