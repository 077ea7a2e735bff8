import numpy as np

from glyphflow.llm import queries, toxicity


def brute(texts):
    """Buckets of each text, one n-gram at a time."""
    out = []
    for t in texts:
        b = b" " + " ".join((t or "").lower().split()).encode() + b" "
        found = set()
        for k in toxicity.ORDERS:
            for i in range(len(b) - k + 1):
                h = b[i]
                for c in b[i + 1 : i + k]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                h = ((h ^ (h >> 15)) * 0x85EBCA6B + (k * 0x9E3779B1 & 0xFFFFFFFF)) & 0xFFFFFFFF
                found.add((((h ^ (h >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
        out.append(sorted(found))
    return out


def test_features():
    texts = ["You  IDIOT\n", "", None, "a", "Éa ê " * 50, "zz"]
    doc, bucket = toxicity._distinct(*toxicity._hashed(texts))
    assert [bucket[doc == i].tolist() for i in range(len(texts))] == brute(texts)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op1_toxicity(spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    texts = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text rlike '(?i)loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid' as insult")
    rows = found.join(truth, "doc_id").join(texts, "doc_id").collect()
    assert found.count() == 10000
    held = [r for r in rows if r.held_out]
    # here two in five toxic labels mark texts without any insult, which no classifier can tell
    assert np.mean([r.predicted for r in held if r.toxic and r.insult]) > 0.95
    assert np.mean([r.predicted for r in held if not r.toxic]) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)
    # over all held-out rows, those that can't be told among them
    toxic, clean = (np.array([r.score for r in held if r.toxic == t]) for t in (1, 0))
    auc = (toxic[:, None] > clean).mean() + 0.5 * (toxic[:, None] == clean).mean()
    print("AUC", auc, "recall", (toxic >= 0.3).mean())
    assert auc > 0.93 and (toxic >= 0.3).mean() > 0.5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "bad " * 9000), (3, "bad")], "doc_id long, text string").selectExpr("*", "9 as score")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.3 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 1), (3, None), (3, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_scores_against_brute_force(spark):
    """Ratios, weights and scores of a small table, with dense matrices over the n-grams of each text."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)] + ["vile", "scum"]
    texts = [" ".join(rng.choice(words[:30], 12)) + (" " + str(rng.choice(words[30:])) if i % 3 == 0 else "") for i in range(60)]
    toxic = [int(i % 3 == 0) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (100, "scum of w1"), (101, None), (102, "w3 w4")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))).collect()}
    sets, y = brute(texts), np.array(toxic, float)
    names = sorted({b for s in sets for b in s})
    x = np.array([[b in s for b in names] for s in map(set, sets)], float)
    held, bad = x.sum(axis=0), x[y == 1].sum(axis=0)
    r = np.log((1 + bad) / (y.sum() + 2)) - np.log((1 + held - bad) / ((1 - y).sum() + 2))
    r = np.where((held >= 4) & (np.abs(r) >= 0.7), r, 0)
    f, w, b = x * r, np.zeros(len(names)), np.log(y.mean() / (1 - y.mean()))
    state = np.zeros((4, len(names) + 1))
    for t in range(1, 301):
        err = (1 / (1 + np.exp(-(f @ w + b))) - y) / len(y)
        g = np.append(f.T @ err + 5e-4 * w, err.sum())
        state[0], state[1] = 0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g
        step = 0.02 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, b = w - np.where(r != 0, step[:-1], 0), b - step[-1]
    for doc, text in [*enumerate(texts), (100, "scum of w1"), (101, None), (102, "w3 w4")]:
        own = set(brute([text])[0])
        z = b + sum(wi * ri for n, wi, ri in zip(names, w, r) if n in own)
        assert abs(got[doc] - 1 / (1 + np.exp(-z))) < 1e-3, (doc, got[doc])
    assert got[100] > 0.5 > got[102]
