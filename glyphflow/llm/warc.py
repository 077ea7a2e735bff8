"""WARC derivatives: linked metadata and plain-text conversion records from responses.

``responses`` makes response records of pages; ``read_files`` reads WARC files record by record, ``parse`` records from
bytes (plain, or a gzip member for each record), and ``write_record`` gives their bytes. What isn't a record, or is cut
short, becomes a record of type ``bad`` with the reason as its content type, and reading goes on after it. ``derive`` turns every response into a metadata record (title,
language, character set, links) and a conversion record (plain text). Both refer to the response by its id and keep
its target, date and HTTP status line, content type and payload digest. Records are rows; nothing is shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import _html
from glyphflow.llm._common import small_batches

SCHEMA = "page_id long, type string, record_id string, refers_to string, target_uri string, date string, content_type string, http_status string, source_content_type string, payload_digest string, block_digest string, content_length long, block binary"
NAMES = [c.strip().split()[0] for c in SCHEMA.split(",")]
_KINDS = [pa.int64(), *[pa.string()] * 10, pa.int64(), pa.binary()]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def response(page_id, url: str | None, page: str | None, date: str) -> tuple:
    body = (page or "").encode("utf-8", "surrogatepass")
    kind = "text/html; charset=utf-8"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return page_id, "response", record_id("response", page_id, url, digest(body)), None, url or "", date, "application/http; msgtype=response", "200 OK", kind, digest(body), digest(block), len(block), block


def _line(text: str) -> str:
    return " ".join(text.split())


def derivatives(r: dict) -> list[tuple]:
    """The metadata and conversion records of a response (a row by NAMES)."""
    head, _, body = (r["block"] or b"").partition(b"\r\n\r\n")
    page = body.decode("utf-8", "replace")
    found = [("title", _html.title_of(page)), ("language", _html.language_of(page)), ("charset", _html.charset_of(page))]
    lines = [f"{k}: {_line(v)}\r\n" for k, v in found if v]
    for link in _html.links_of(page):
        try:
            lines.append(f"outlink: {_line(urljoin(r['target_uri'] or '', link.strip()))} L a/@href\r\n")
        except ValueError:  # a link that isn't an address
            continue
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", "".join(lines)), ("conversion", "text/plain; charset=utf-8", _html.text_of(page))):
        block = block.encode("utf-8", "replace")
        out.append((r["page_id"], kind, record_id(kind, r["record_id"]), r["record_id"], r["target_uri"], r["date"], content, r["http_status"], r["source_content_type"], r["payload_digest"], digest(block), len(block), block))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names=NAMES)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record for each row. Null pages are empty, null addresses too; repeated rows give repeated records."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128).to_pydict()
                yield _batch([response(*r, date) for r in zip(*part.values())])

    return pages.select(F.col(id_col).cast("long").alias("a"), F.col(url_col).cast("string").alias("b"), F.col(html_col).cast("string").alias("c")).mapInArrow(run, SCHEMA)


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response among ``records``; others are passed over.

    A null or empty block gives empty derivatives; null headers stay null; repeated responses are derived each; columns
    that aren't a record's are ignored; no rows give no rows. A very long block is held by one task, a row at a time.
    """
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                yield _batch([d for r in batch.slice(a, 128).to_pylist() for d in derivatives(r)])

    return records.where("type = 'response'").select(*NAMES).mapInArrow(run, SCHEMA)


_HEADERS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "http_status": "WARC-Source-HTTP-Status", "source_content_type": "WARC-Source-Content-Type", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest", "content_length": "Content-Length"}


def write_record(r: dict) -> bytes:
    """The record as a gzip member of a WARC/1.0 file."""
    lines = ["WARC/1.0"] + [f"{h}: {_line(str(r[k]))}" for k, h in _HEADERS.items() if r[k] is not None]
    if r["page_id"] is not None:
        lines.append(f"X-Page-ID: {r['page_id']}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + (r["block"] or b"") + b"\r\n\r\n", mtime=0)


MARK = b"WARC/1."
_STATUS = re.compile(rb"HTTP/[0-9.]+ +([^\r\n]*)")


def _record(head: bytes, block: bytes, length: int | None) -> dict:
    """A row by NAMES from the lines between MARK and the empty line, and the block."""
    back, r = {h.lower(): k for k, h in _HEADERS.items()}, dict.fromkeys(NAMES)
    for line in head.split(b"\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        k, v = k.strip().lower(), v.strip()
        if k == "x-page-id":
            r["page_id"] = int(v) if re.fullmatch(r"-?[0-9]{1,18}", v) else None
        elif k in back:
            r[back[k]] = v
    r["content_length"], r["block"] = length, block
    if r["type"] == "response" and r["http_status"] is None:
        said = _STATUS.match(block)
        r["http_status"] = said[1].decode("latin-1").strip() if said else None
        lines = block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]
        r["source_content_type"] = next((h.partition(":")[2].strip() for h in lines if h.lower().startswith("content-type:")), None)
    return r


def _bad(why: str, piece: bytes) -> dict:
    return dict.fromkeys(NAMES) | {"type": "bad", "content_type": why, "content_length": len(piece), "block": piece}


def _records(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of what stands between marks, in order. A block that holds the mark itself is put together again."""
    held, head, length = b"", b"", None  # of a record whose block isn't complete
    for piece in pieces:
        if length is not None:
            held += MARK + piece
        else:
            if not piece.strip():
                continue
            head, empty, held = piece.partition(b"\r\n\r\n")
            said = re.search(rb"\ncontent-length:[ \t]*([^\r\n]*)", head, re.I)
            if not empty or not re.match(rb"[0-9]\r?\n", head):
                yield _bad("not a record", piece)
                continue
            if said is None or not re.fullmatch(rb"[0-9]{1,18}", said[1].strip()):
                yield _bad("no length", piece)
                continue
            length = int(said[1])
        if len(held) >= length:
            yield _record(head, held[:length], length)
            length = None
    if length is not None:
        yield _bad("cut short", MARK + head + b"\r\n\r\n" + held)


def _inflated(data: bytes) -> bytes:
    """Gzip members one after another, as far as they can be read."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, as rows by NAMES."""
    return _records(iter((_inflated(data) if data[:2] == b"\x1f\x8b" else data).split(MARK)))


def read_files(spark, path: str) -> DataFrame:
    """Records of the WARC files at ``path``, compressed or not, of any size: a task holds a record at a time.

    Files are read as lines that end at the mark of a record. A compressed file that breaks off gives what could be
    read of it; a record that is cut short there or at the end of a file is bad.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces(rows: Iterator[tuple[str, bytes]]) -> Iterator[bytes]:
            return (p for _, p in rows)

        rows = ((f.as_py(), p.as_py()) for batch in batches for f, p in zip(batch.column(0), batch.column(1)))
        out = []
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            for r in _records(pieces(own)):
                out.append(tuple(r[k] for k in NAMES))
                if len(out) == 64:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    lines = spark.read.option("ignoreCorruptFiles", True).text(path, lineSep=MARK.decode())
    return lines.select(F.input_file_name(), F.col("value").cast("binary")).mapInArrow(run, SCHEMA)
