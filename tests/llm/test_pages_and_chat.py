import base64
import gzip
import hashlib
import math
import re
import time

import duckdb
import numpy as np

from glyphflow.llm import _html, chat, langid, queries, warc
from tests.oracle import compare


def test_chat_query(spark, tiny):
    compare(spark, tiny, queries.op5_chat, queries.OP5_SQL)


def test_chat_segments(spark, tmp_path):
    """Parts go by the count of turns, not by their numbers; later ones open with the system turn in force; the query and
    its SQL agree on it."""
    rows = [(1, t, "system" if t in (0, 5) else "Ann" if t % 2 else "Bob", f"t{t}") for t in range(4096)] + [(1, 4096 + t, "Ann", f"u{t}") for t in range(3)] + [(1, 13000, "Bob", "w")]
    rows += [(2, t, "Ann" if t % 2 else "Bob", f"x{t}") for t in range(4090, 4102)] + [(3, None, "Ann", f"y{t % 5000}") for t in range(9000)] + [(None, 7, "Ann", "same")] * 5000
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.segment, r.speaker): r for r in queries.op5_chat(spark, str(tmp_path)).collect()}
    assert got[1, 1, "Ann"].text.startswith("<|im_start|>system\nt5<|im_end|>\n<|im_start|>assistant\nu0") and got[1, 1, "Ann"].n_turns == 4
    assert got[2, 0, "Ann"].n_turns == 12 and {s for c, s, _ in got if c == 2} == {0}
    assert [got[3, s, "Ann"].n_turns for s in range(3)] == [4096, 4096, 808] and [got[None, s, "Ann"].n_turns for s in range(2)] == [4096, 904]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.OP5_SQL).fetchall()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, want), key=key) == sorted(((r.conv_id, r.segment, r.speaker, r.n_turns, r.text, r.mask) for r in got.values()), key=key)


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Ann", "hi <|im_end|>"), (1, 2, "Bo b", None), (1, 2, "Bo b", None), (1, None, None, "é"), (2, 0, "system", "alone"), (None, 0, "a", "x"), (3, 5000, "a", "far"), (3, 1, "b", "near")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as segment", "2 as speaker")
    got = {(r.conv_id, r.segment, r.speaker): r for r in chat.rotate(df).collect()}
    assert {k for k in got if k[0] == 1} == {(1, 0, w) for w in ("Ann", "Bo b", "unknown")} and (2, 0, "system") not in got and (None, 0, "a") in got
    one = got[1, 0, "Bo b"]
    assert one.text == "<|im_start|>user name=unknown\né<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=Ann\nhi < |im_end|><|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2
    assert [one.text[m.start : m.end] for m in one.mask] == ["<|im_end|>"] * 2 and one.n_turns == 5
    assert len(got[3, 0, "b"].mask) == 1 and {s for c, s, _ in got if c == 3} == {0}
    assert chat.rotate(df.limit(0)).collect() == []


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    got = {r.id: r for r in langid.identify(docs, model, host_col="source").collect()}
    right = sum(got[r.doc_id].lang == r.lang for r in docs.collect())
    assert right > 0.98 * len(got) and not any(r.rejected for r in got.values())
    pages = queries.op8_language(spark, sf).collect()
    assert len(pages) == 250 and sum(p.lang == p.declared for p in pages) > 240
    odd = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "123 !!", "a"), (None, "the of and", None), (4, "the " * 60000, "b"), (4, "the " * 60000, "b")], "doc_id long, text string, source string").selectExpr("*", "1 as h", "2 as host")
    back = {(r.id, r.text_lang): r for r in langid.identify(odd, model, host_col="source").collect()}
    assert back[1, "und"].rejected and back[2, "und"].rejected and back[3, "und"].rejected and back[4, "en"].lang == "en" and (None, "en") in back
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4]
    assert langid.identify(odd.limit(0), model).collect() == [] and langid.identify(odd, langid.fit(docs.limit(0))).where("rejected").count() == 6


def test_priors_decide_what_text_leaves_open(spark):
    docs = spark.createDataFrame([("aaa bbb", "x"), ("ccc ddd", "y")], "text string, lang string")
    model = langid.fit(docs)
    page = lambda lang, body: f"<html lang='{lang}'><p>{body}</p></html>"
    rows = [(i, f"http://{h}.example.org/", page(lang, body)) for i, (h, lang, body) in enumerate([("h", "x", "aaa bbb")] * 30 + [("g", "y", "ccc ddd")] * 30 + [("h", "x", "eee"), ("g", "y", "eee")])]
    got = {r.id: r.lang for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model, "page_id", "html", "url", html=True).collect()}
    assert got[60] == "x" and got[61] == "y"


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a.example/x/", "<html lang=de><head><title>T &amp; U</title><script>var a='<p>'</script></head><body><p>One <b>two</b><br>three<a href='../y?a=1&amp;b=2'>l</a><a href=\"http://[bad\">m</a></p></body></html>"), (2, None, None), (None, "u", ""), (3, "http://b", "<" * 20000 + "<script" * 3000), (3, "http://b", "<p>same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as type", "2 as block")
    found = warc.responses(df)
    made = warc.derive(found).collect()
    sources = {r.record_id: r for r in found.collect()}
    assert len(made) == 10 and all(r.refers_to in sources for r in made)
    for r in made:
        s = sources[r.refers_to]
        assert (r.target_uri, r.date, r.payload_digest, r.source_content_type, r.http_status) == (s.target_uri, s.date, s.payload_digest, s.source_content_type, s.http_status)
        assert r.content_length == len(r.block) and r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.block)).digest()).decode()
    by = {(r.page_id, r.type): bytes(r.block).decode() for r in made}
    assert by[1, "conversion"] == "T & U\nOne two\nthreelm" and by[1, "metadata"] == "title: T & U\r\nlanguage: de\r\noutlink: http://a.example/y?a=1&b=2 L a/@href\r\n"
    data = b"".join(warc.write_record(r.asDict()) for r in [*found.collect(), *made])
    (tmp_path / "x.warc.gz").write_bytes(data)
    back = warc.read_files(spark, str(tmp_path))
    assert sorted((r.record_id, r.block_digest, bytes(r.block)) for r in back.collect()) == sorted((r.record_id, r.block_digest, bytes(r.block)) for r in [*found.collect(), *made])
    assert sorted(r.record_id for r in warc.derive(back).collect()) == sorted(r.record_id for r in made)
    assert warc.derive(warc.responses(df.limit(0))).collect() == []


def test_html_text():
    assert _html.text_of(None) == "" and _html.text_of("<!-- a <p>b</p>") == "" and _html.text_of("1 < 2 <i>x</i>") == "1 < 2 x"


def test_html_is_read_in_linear_time():
    for page in ("<a " * 40000, "<meta http-equiv " * 10000, "<title " * 30000, "<html lang" * 20000, "<a " + "x" * 100000, '<a x="' * 20000, "<script " * 20000, "<meta " + "charset " * 30000):
        began = time.time()
        _html.title_of(page), _html.language_of(page), _html.charset_of(page), _html.links_of(page), _html.text_of(page)
        assert time.time() - began < 2, page[:20]
    page = "<HTML data-lang=x Lang='DE-at'><meta charset = \"utf-8\"><title a=1>T &amp; U</title><a title='href=no' href=y&amp;z>l</a><a HREF = 'q'></a><a nohref=1>"
    assert (_html.language_of(page), _html.charset_of(page), _html.title_of(page), _html.links_of(page)) == ("de", "utf-8", "T & U", ["y&z", "q"])
    assert _html.language_of("<meta http-equiv=Content-Language content='fr, en'>") == "fr" and _html.language_of("<html>") is None


def test_malformed_warc(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i} WARC/1.0 inside</p>" + "x" * 3000) for i in range(5)], "page_id long, url string, html string")
    good = [r.asDict() for r in warc.responses(pages).collect()]
    one = [gzip.decompress(warc.write_record(r)) for r in good]
    plain = b"junk before\r\n" + one[0] + one[1].replace(b"Content-Length: ", b"Content-Length: q", 1) + one[2].replace(b"X-Page-ID: 2", b"X-Page-ID: two") + b"WARC/1.0 no headers" + one[3] + one[4][:-900]
    got = list(warc.parse(plain))
    assert [(r["type"], r["page_id"]) for r in got] == [("bad", None), ("response", 0), ("bad", None), ("bad", None), ("response", None), ("bad", None), ("response", 3), ("bad", None)]  # the block without a length holds the mark
    assert got[1]["block"] == good[0]["block"] and [r["content_type"] for r in got if r["type"] == "bad"] == ["not a record", "no length", "not a record", "not a record", "cut short"]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(plain)
    (tmp_path / "zipped").mkdir()
    whole = b"".join(warc.write_record(r) for r in good)
    (tmp_path / "zipped" / "b.warc.gz").write_bytes(whole[:-100])
    assert sorted(str(r.type) for r in warc.read_files(spark, str(tmp_path / "plain")).collect()) == sorted(r["type"] for r in got)
    back = warc.read_files(spark, str(tmp_path / "zipped")).collect()
    assert {r.page_id for r in back if r.type == "response"} >= {0, 1, 2} and all(r.type in ("response", "bad") for r in back)
    assert [r["page_id"] for r in warc.parse(whole[:-100]) if r["type"] == "response"] == [0, 1, 2, 3]
    assert list(warc.parse(b"")) == [] and warc.derive(warc.read_files(spark, str(tmp_path / "plain"))).count() == 6


def test_warc_query_against_brute_force(spark):
    """Every page of the table, made anew from the definitions: linked, with digests and plain text."""
    sf = "/root/testdata/sf0.01"
    rows = {(r.page_id, r.type): r for r in queries.op10_warc(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == 2 * len(pages)
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for p in pages:
        body = (p.html or "").encode()
        meta, text = rows[p.page_id, "metadata"], rows[p.page_id, "conversion"]
        assert meta.refers_to == text.refers_to and meta.record_id != text.record_id and meta.payload_digest == text.payload_digest == sha(body)
        assert all(r.target_uri == p.url and r.http_status == "200 OK" and r.content_length == len(r.block.encode()) and r.block_digest == sha(r.block.encode()) for r in (meta, text))
        visible = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ", p.html or "")
        import html as h

        assert text.block.split() == h.unescape(re.sub(r"(?s)<[a-zA-Z/!?][^>]*>", lambda m: "\n" if re.match(r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|header|footer|nav|title|body|head|html|blockquote|pre)\b", m[0]) else "", visible)).split()
        title = re.search(r"(?is)<title[^>]*>([^<]*)", p.html or "")
        assert ("title: " + " ".join(h.unescape(title[1]).split()) in meta.block) if title and title[1].strip() else "title:" not in meta.block


def test_language_query_against_brute_force(spark):
    """Posteriors of every page, from votes counted one by one without the row's own."""
    sf = "/root/testdata/sf0.01"
    langs, shares = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    table = np.frombuffer(shares, np.float32).reshape(len(langs), -1)
    rows = []
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        text, host = _html.text_of(p.html), re.sub(r"^\w+://([^/:]*).*$", r"\1", p.url).lower()
        path = re.sub(r"^\w+://[^/]*", "", p.url).split("/")
        code = next((c for c in (path[1].lower() if len(path) > 1 else "", host.rpartition(".")[2]) if c in langs), None)
        declared = _html.language_of(p.html)
        g = langid._grams(text)
        ll = table[:, g].sum(axis=1) * min(1.0, langid.WEIGHT / len(g)) if any(c.isalpha() for c in text) else None
        rows.append((p.page_id, host, declared if declared is None or declared in langs else "other", code, None if ll is None else ll - ll.max()))
    vote = [None if r[4] is None else int(np.argmax(r[4])) for r in rows]
    got = {r.page_id: r for r in queries.op8_language(spark, sf).collect()}
    domain = lambda h: ".".join(h.split(".")[-2:])
    whole = np.array([sum(v == i for v in vote) + 1.0 for i in range(len(langs))])
    for k, (page, host, declared, code, ll) in enumerate(rows):
        def counted(same):
            return np.array([sum(v == i and same(r) for n, (r, v) in enumerate(zip(rows, vote)) if n != k) for i in range(len(langs))], float)

        on_domain, on_host = counted(lambda r: domain(r[1]) == domain(host)), counted(lambda r: r[1] == host)
        prior = (on_domain + langid.DOMAIN_STRENGTH * whole / whole.sum()) / (on_domain.sum() + langid.DOMAIN_STRENGTH)
        prior = (on_host + langid.HOST_STRENGTH * prior) / (on_host.sum() + langid.HOST_STRENGTH)
        p = ll + np.log(prior)
        for at, value in ((2, declared), (3, code)):
            if value is not None:
                values = len({r[at] for r, v in zip(rows, vote) if r[at] is not None and v is not None})
                p = p + np.log((counted(lambda r: r[at] == value) + 1) / (counted(lambda r: r[at] is not None) + values + 1))
        p = np.exp(p - p.max())
        assert math.isclose(got[page].confidence, p.max() / p.sum(), rel_tol=1e-3), (page, got[page], p)
        assert got[page].lang == langs[int(np.argmax(p))] and got[page].host == host and got[page].declared == declared
