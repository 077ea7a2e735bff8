import hashlib
import re

from glyphflow.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    None, "", "a@b.c_d@e.f x@y a@b@c.d é@x.y ééa.b@c-d.e.f.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3 4.5.6.7 12345678901234567890.1.2.3",
    "4111 1111-1111 1111 4111111111111111 4111-1111-1111-1112 1 2 3", "+1 (988) 555-2485 +1-2 +123456789012345678 ++49 30 1234567 +1.2.3.4.5.6.7.8.9",
    "9" * 30000 + " " + "1 " * 5000 + "a" * 30000 + "@", "mail x@y.zz " * 300, "\U0001f600 4111111111111111 \U0001f600 q@w.er", "@" * 50 + "1", "a@b.c" * 50,
]


def test_base_spans(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as base", "2 as h", "3 as spans")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.find(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_bootstrap_and_redaction(spark):
    rows = [(i, f"word{i:02d}x customer reach a{i}b@mail.example.com today said member{i}") for i in range(20)]
    rows += [(50, "reach a77b@mail-example today"), (51, "other a77b@mail-example2 later"), (None, "reach a78b@mail-example today"), (52, "x 4111111111111111 y"), (53, "x 4111111111111111 y"), (53, "x 4111111111111111 y"), (54, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _h", "2 as base").drop("_h")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df).collect()}
    assert all(got[i] == brute(rows[i][1]) for i in range(20)) and got[51] == [] and got[54] == []
    cut = [(r.doc_id, r.text) for r in pii.redact(df).collect()]
    assert len(cut) == len(rows) and dict(cut)[0] == "word00x customer reach [EMAIL] today said member0"
    assert dict(cut)[52] == "x [CARD] y" and dict(cut)[54] is None and pii.redact(df).columns == df.columns
    assert pii.find(df.limit(0)).collect() == [] and pii.redact(df.limit(0)).collect() == []


def test_discovery(spark):
    # the account numbers aren't of any base kind, but stand where addresses stand
    seeds = [(i, f"contact {i}.{i}.7.{i} please") for i in range(10, 40)]
    df = spark.createDataFrame([*seeds, (90, "contact 300.7.7.12 please"), (91, "sum 300.1.7.12 only")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df).collect()}
    assert got[90] == [("id", 8, 18)] and got[91] == [] and got[10] == [("ip", 8, 18)]


def test_secrets_by_their_context(spark):
    """Assigned tokens show what their surroundings look like; shorter ones there are found too, others elsewhere not."""
    hexed = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'word{i} said token = "{hexed(i)}" and more') for i in range(30)]
    rows += [(50, 'here token = "ab12cd" too'), (51, f"commit {hexed(51)} of today"), (52, f"lone_key = {hexed(52)}"), (53, f'x TOKEN = "{hexed(53).upper()}" y'), (54, f"see http://h.example/?q={hexed(54)} now"), (None, f'said token = "{hexed(99)}" and'), (55, 'token = "' + hexed(1) + '"'), (55, 'token = "' + hexed(1) + '"')]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as inst", "2 as contexts")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df).collect()}
    text = dict(rows)
    assert all(got[i] == [("id", text[i].index('"') + 1, text[i].index('"') + 41)] for i in [*range(30), 53, None, 55])
    assert got[50] == [("id", 14, 20)] and got[51] == got[52] == got[54] == []
    assert dict((r.doc_id, r.text) for r in pii.redact(df).collect())[3] == 'word3 said token = "[ID]" and more'
    few = spark.createDataFrame(rows[:3], "doc_id long, text string")
    assert all(r.spans == [] for r in pii.find(few).collect())


def test_masks(spark):
    """Spans that overlap become one, in whatever order they come; null texts stay null."""
    rows = [("abcdef", [("id", 3, 5), ("ip", 1, 4)]), ("abc", []), (None, [("ip", 0, 1)]), ("\U0001f600bc", [("card", 0, 1), ("card", 0, 1)])]
    df = spark.createDataFrame(rows, "t string, s array<struct<kind:string,start:long,end:long>>")
    assert [r.m for r in df.select(pii.masked(df.t, df.s).alias("m")).collect()] == ["a[IP]f", "abc", None, "[CARD]bc"]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op4_pii(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = brute(r.text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        got = rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and got.spans.startswith(line)
        assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == tuple(sum(k == x for k, *_ in want) for x in ("email", "ip", "card", "phone"))
