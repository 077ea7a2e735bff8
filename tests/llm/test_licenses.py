import re

from glyphflow.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = WORD.findall((text or "").translate(ASCII))
    at, labels = [], set()
    for p, label in licenses.BASE.items():
        p = p.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted(labels)


def test_base_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert {k: v[:5] for k, v in got.items()} == want
    assert all(set(v[4]) <= set(v[5]) and 0 <= v[6] <= 1 for v in got.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(("cc-by-nc" in v[5]) == ("CC BY-NC 4.0" in texts[k]) for k, v in got.items())


def test_odd_rows_and_templates(spark):
    bsd = "Redistribution and use in source and binary forms, with or\n * without modification, are permitted provided that the following conditions are met:"
    rows = [(1, None), (2, ""), (3, "MIT\x7fLicense mit license"), (3, "MIT\x7fLicense mit license"), (None, "x " * 50000 + bsd), (4, "GNU lesser general public license"), (5, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + bsd), (6, "binary forms source modification redistribution conditions"), (7, "Éapache license")]
    rows += [(100 + i, f"plain text of the number {i} in which nothing is granted") for i in range(50)]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as labels", "2 as score")).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert by[1].n_words == by[2].n_words == 0 and by[1].first_word is None and by[1].labels == []
    assert (by[3].n_base, by[3].first_word, by[3].last_word, by[3].base_labels) == (2, 0, 2, ["mit"])
    assert by[None].labels == ["bsd"] and by[None].base_labels == [] and by[None].score > 0.9
    assert by[4].base_labels == ["gpl"] and by[5].labels == ["bsd", "isc"] and by[6].labels == [] and by[7].n_base == 0
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, tiny):
    df = queries.op6_licenses(spark, tiny)
    assert df.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and df.count() == 200


def aligned(words, index):
    """(labels, best score): every template held against every start, pair by pair, without an index."""
    labels, best = set(), 0.0
    for t in licenses.TEMPLATES:
        own, phrases = licenses._words(t.text), [licenses._words(p) for p in t.phrases]
        if not all(any(words[i : i + len(p)] == p for i in range(len(words) - len(p) + 1)) for p in phrases):
            continue
        pairs = list(zip(own, own[1:]))
        for start in range(-len(own), len(words)):
            held = words[max(0, start) : max(0, start + len(own) + 3)]
            if all(any(held[i : i + len(p)] == p for i in range(len(held) - len(p) + 1)) for p in phrases):
                left, n = list(zip(held, held[1:])), 0
                for x in pairs:
                    if x in left:
                        left.remove(x)
                        n += 1
                if n / max(1, len(pairs)) >= 0.6:
                    labels.add(t.label)
                    best = max(best, n / max(1, len(pairs)))
    return labels, best


def test_places_against_brute_force():
    """Whole notices in prose, as comments, with words that differ, and only in part: what alignment finds, places find."""
    index = licenses.Index(licenses.TEMPLATES, 1000, {w: 500 for w in (b"the", b"of", b"and", b"this", b"or", b"to")})
    whole = [t for t in licenses.TEMPLATES if len(licenses._words(t.text)) > 25]
    for k, t in enumerate(whole):
        words = t.text.split()
        noted = "\n * ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        cases = [f"Copyright 2020 A. Author\n * {noted}\n */ int main() {{}}", "some prose before it. " * 7 + t.text.upper() + " and more after it", " ".join(w if (i + k) % 23 else "changed" for i, w in enumerate(words)), " ".join(words[: len(words) // 4]), " ".join(reversed(words))]
        for at, text in enumerate(cases):
            own = licenses._words(text)
            want, best = aligned(own, index)
            found = list(index.places(own))
            labels = {licenses.TEMPLATES[i].label for i, *_ in found}
            # a notice of which words changed, or of which a part moved, may lack the votes of its rare words
            assert labels <= want and (t.label in labels or at > 2 or t.label not in want), (t.label, at)
            assert best - max((x for *_, x in found), default=0.0) < 0.1 or at > 1, (t.label, at)
        assert t.label in aligned(licenses._words(cases[0]), index)[0]
