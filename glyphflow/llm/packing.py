"""Sequence packing by best-fit decreasing over a segment tree of remaining capacities.

Every document becomes token ids followed by an end id. A document longer than a window is first cut into full
windows; what is left over is a piece shorter than a window. Pieces are placed longest first, each into the open
window with the least room that still takes it. A segment tree indexed by remaining capacity finds that window in
``log2(capacity)`` steps.

Packing runs inside the tasks that read the documents, without a shuffle. A task gathers pieces until they hold
``batch_tokens`` ids, packs them, emits them and starts anew, so memory is bounded however large a partition is.
At most about one window a batch stays partly empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm._common import small_batches

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_encoders: dict = {}


def encoder(path: str):
    """``texts -> list of id lists`` for the byte-level BPE file of the ``tokenizers`` library at ``path``.

    Texts of Latin-1 characters take a faster engine over the same vocabulary, split pattern and special tokens,
    for which both engines agree on every character class; every other text takes ``tokenizers`` itself, and so
    does every text when the file isn't a plain byte-level BPE (one whose ids are the ranks of its merges).
    """
    if path not in _encoders:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            fast = _rank_engine(json.load(f))

        def encode(texts: list[str]) -> list[list[int]]:
            out: list = [None] * len(texts)
            rest = []
            for i, t in enumerate(texts):
                if fast is not None and _latin(t):
                    out[i] = fast.encode(t, allowed_special="all")
                else:
                    rest.append(i)
            if rest:
                for i, e in zip(rest, slow.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
                    out[i] = e.ids
            return out

        _encoders[path] = encode
    return _encoders[path]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _rank_engine(spec: dict):
    """The vocabulary of a plain byte-level BPE file as a rank-merging encoder, or None if it isn't one."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    plain = (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(spec.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ()))
    )
    if not plain:
        return None
    import public_tokenizers
    import tiktoken

    # byte-level files spell each byte as one printable character: printable Latin-1 bytes as themselves, the others from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {bytes(byte_of[ch] for ch in tok): i for tok, i in model["vocab"].items() if tok not in special}
    if sorted(ranks.values()) != list(range(len(ranks))) or len(ranks) != 256 + len(model["merges"]):
        return None
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the tightest one that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)  # windows below each node
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, by: int) -> None:
        node, count = room + self.leaves, self.count
        while node:
            count[node] += by
            node >>= 1

    def put(self, window: int, room: int) -> None:
        self.at[room].append(window)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (window, room) of the least room >= size."""
        count, node = self.count, size + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up until a right neighbour holds a window
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.at[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """(window of each piece, offset of each piece in it, number of windows). Ties keep the given order."""
    windows, where, offset = OpenWindows(capacity), [0] * len(lengths), [0] * len(lengths)
    n = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        found = windows.take(size) if size < capacity else None
        if found is None:
            found, n = (n, capacity), n + 1
        where[i], offset[i] = found[0], capacity - found[1]
        if found[1] > size:
            windows.put(found[0], found[1] - size)
    return where, offset, n


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, batch_tokens: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the place of a tokenizer file that every worker can read. ``batch_tokens`` bounds the ids
    that a task holds. Null and empty texts are documents of the end id alone; a null doc_id stays null; repeated
    rows are documents of their own; other columns are ignored, whatever their names; no rows give no rows.
    A sequence is named by its task and its number there, so a task that runs again gives the same names.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        pieces: list[tuple] = []
        held, made = 0, 0

        def flush():
            nonlocal pieces, held, made
            where, offset, n = best_fit_decreasing([p[2] for p in pieces], capacity)
            order = sorted(range(len(pieces)), key=lambda i: (where[i], offset[i]))
            for a in range(0, len(order), 4000):
                part = order[a : a + 4000]
                cols = [list(c) for c in zip(*(pieces[i] for i in part))]
                cols += [[(task << 36) + made + where[i] for i in part], [offset[i] for i in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            pieces, held, made = [], 0, made + n

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(ids), 256):
                for doc, tokens in zip(ids[a : a + 256], encode([t or "" for t in texts.slice(a, 256).to_pylist()])):
                    tokens = np.array([*tokens, end_id], "<u4")
                    for s in range(0, len(tokens), capacity):
                        cut = tokens[s : s + capacity]
                        pieces.append((doc, s, len(cut), cut.tobytes(), len(tokens)))
                    held += len(tokens)
                    if held >= batch_tokens:
                        yield from flush()
        if pieces:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
