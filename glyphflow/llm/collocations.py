"""Collocations: frequent phrases, scored by how much oftener their parts meet than chance has it.

First, every task counts phrases in a count-min sketch, the tasks' sketches are summed block by block, and of the sum only
one bit a counter is kept: whether it reaches the least count. A sketch never counts too little, so a phrase with a clear
bit isn't frequent, and no frequent one is lost. Words and pairs are sketched first. A longer phrase is only sketched if all
the pairs in it may be frequent, which leaves out nearly all of the rare ones, and they are most of what fills counters.
Then phrases with all bits set are counted exactly, by their text, in a grouped aggregation. What was frequent only in the
sketch then goes. Parts of a frequent phrase are at least as frequent, so their counts are all there. Scores, in exact
whole numbers, and subsumption are joins over the frequent phrases.

Within a task, the words of some megabytes of text are numbered and phrases counted as numbers. Counts of one slice of text
after the other are summed by phrase before they leave the task (``HELD`` rows at most are held, then they are sent on), and
there are no more tasks than cores take in two rounds. So what is shuffled, of sketches as of counts, goes by tasks times
what each has, and the number of tasks doesn't grow with the text. A sketch has a fixed size (``width`` counters in each of ``DEPTH`` rows; a task sends
those that it counted in, so no more than its text has phrases, and the driver and all tasks hold a bit each): with far
more text than ``width`` is made for, fewer phrases are ruled out, and the last pass counts more, but nothing else changes.
A language with most of the rows is one key of nothing but
its total and its ranks, and those are found among the best of ``SALTS`` parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphflow.llm._common import ascii_lower, stored

LONGEST = 5
HELD = 1 << 19  # rows of counts in a task
DEPTH = 3
MOST_WIDTH = 1 << 24
BLOCK = 1 << 16  # counters of a sketch that are summed together
SLICE = 8 << 20  # bytes of text that a task numbers at a time
SALTS = 64


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(texts: pa.Array):
    """A 64-bit number of each text, the same in every task."""
    import numpy as np

    if not len(texts):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    to = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = np.diff(to)
    at = np.arange(to[0], to[-1]) - np.repeat(to[:-1], size)
    byte = np.random.default_rng(1).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(byte[data[to[0] : to[-1]]] * power[at])])
    return _mixed(sums[to[1:] - to[0]] - sums[to[:-1] - to[0]] + size.astype(np.uint64))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``SLICE`` bytes of text; a longer text comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        to = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            before = to[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(to, before + SLICE - size, "right")))
            held.append(batch.slice(a, b - a))
            size += int(to[b - 1] - before)
            a = b
            if size >= SLICE or a < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _words(part: pa.RecordBatch):
    """words (distinct), and for each occurrence its word's number, its row, and how many words its piece has from it on."""
    import numpy as np

    column = part.column("text")
    to = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[to[0] : to[-1]]
    to = to - to[0]
    kind = np.zeros(256, np.uint8)
    kind[[0x20, 0x09]] = 1
    kind[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
    kind = kind[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    opens, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = to[(to > 0) & (to < len(data))]
    opens[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(ends) + 1
    if not len(first):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(size.tobytes()), pa.py_buffer(data[kind == 0].tobytes())).dictionary_encode()
    row = np.searchsorted(to, first, "right") - 1
    piece = row + np.cumsum(kind == 2, dtype=np.int64)[first]
    turns = np.flatnonzero(np.diff(piece)) + 1
    closes = np.repeat(np.concatenate([turns, [len(first)]]), np.diff(np.concatenate([[0], turns, [len(first)]])))
    return texts.dictionary, texts.indices.to_numpy().astype(np.int64), row, closes - np.arange(len(first))


def _phrases(part: pa.RecordBatch, kept, longest: int = LONGEST):
    """First the languages, the words, and the words of each language; then for every length: hash, count, number of the
    beginning (of words: the language), number of the last word, use, of the distinct phrases. ``kept(k, hashes)`` says which
    phrases may be frequent: others, and longer ones with those among their words or pairs, are of no use."""
    import numpy as np
    import pandas as pd

    words, word, row, left = _words(part)
    langs = part.column("lang").dictionary_encode()
    lang_hash, word_hash, n = _hashes(langs.dictionary), _hashes(words), max(len(words), 1)
    lang = langs.indices.to_numpy()[row].astype(np.int64)
    yield langs.dictionary, words, np.bincount(lang, minlength=len(langs.dictionary))
    at, begin, begin_hash = np.arange(len(word)), lang, lang_hash
    follows = np.zeros(len(word), bool)  # whether the pair that begins at a word may be frequent
    for k in range(1, longest + 1):
        code, pairs = pd.factorize(begin * n + word[at + k - 1])
        before, last = pairs // n, pairs % n
        found = _mixed(begin_hash[before] * np.uint64(0xD1342543DE82EF95) + word_hash[last] + np.uint64(k))
        use = kept(k, found)
        yield found, np.bincount(code, minlength=len(pairs)), before, last, use
        good = use[code]
        if k == 2:
            follows[at[good]] = True
        go = good & (left[at] > k)
        if k > 1:
            go[go] = follows[at[go] + k - 1]
        at, begin, begin_hash = at[go], code[go], found


def _rows_of(found, width: int):
    """The counter of a hash in each row of the sketch, the rows one after the other."""
    import numpy as np

    mask = np.uint64(width - 1)
    return [(_mixed(found + np.uint64(d * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask).astype(np.int64) + d * width for d in range(DEPTH)]


def _among(found, bits, width: int):
    """Which hashes have all their bits set."""
    import numpy as np

    use = np.ones(len(found), bool)
    for at in _rows_of(found, width):
        use &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return use


def _packed(block, kind: str) -> bytes:
    """A block of counters: all of them, or where few aren't 0, the places and values of those."""
    import numpy as np

    at = np.flatnonzero(block)
    if len(at) * (2 + block.itemsize) < block.nbytes:
        return b"s" + at.astype("<u2").tobytes() + block[at].tobytes()
    return b"d" + block.tobytes()


def _unpacked(data: bytes, kind: str, size: int):
    import numpy as np

    if data[:1] == b"d":
        return np.frombuffer(data, kind, offset=1).astype(np.int64)
    n = (len(data) - 1) // (2 + np.dtype(kind).itemsize)
    out = np.zeros(size, np.int64)
    out[np.frombuffer(data, "<u2", n, 1)] = np.frombuffer(data, kind, n, 1 + 2 * n)
    return out


def _sketch(docs: DataFrame, width: int, least: int, pairs=None):
    """One bit a counter: whether the sum of all tasks' sketches reaches ``least`` there (NumPy array, packed): of words and
    pairs, or with the bits of those (``pairs``) of longer phrases."""
    import numpy as np

    small, size = "u1" if least < 256 else "<u4", min(BLOCK, DEPTH * width)
    sent = None if pairs is None else docs.sparkSession.sparkContext.broadcast(pairs)

    def kept(k, found):
        return np.ones(len(found), bool) if sent is None or k > 2 else _among(found, sent.value, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # no counter needs more than ``least``; so many phrases at a time can't carry one of two bytes over in a wide row
        total = np.zeros(DEPTH * width, np.uint16 if width > 1 << 20 and least < 256 else np.uint32)
        for part in _slices(batches):
            levels = _phrases(part, kept, 2 if sent is None else LONGEST)
            next(levels)
            for k, (found, times, _, _, _) in enumerate(levels, 1):
                if sent is not None and k < 3:
                    continue
                times = np.minimum(times, least).astype(total.dtype)
                for a in range(0, len(found), 1 << 20):
                    for at in _rows_of(found[a : a + (1 << 20)], width):
                        np.add.at(total, at, times[a : a + (1 << 20)])
                        total[at] = np.minimum(total[at], least)
        for a in range(0, len(total), size):
            own = total[a : a + size].astype(small)
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([a // size], pa.int32()), pa.array([_packed(own, small)], pa.binary())], names=["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "bits"])
        for batch in batches:
            for b, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = _unpacked(counts.as_py(), small, size)
                if b != block:
                    if block is not None:
                        yield out()
                    block, total = b, more
                else:
                    total += more
        if block is not None:
            yield out()

    blocks = docs.mapInArrow(count, "block int, counts binary").repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    bits = np.zeros(DEPTH * width // 8, np.uint8)
    for r in blocks.collect():  # DEPTH * width bits, whatever the input
        own = np.frombuffer(r.bits, np.uint8)
        bits[r.block * size // 8 : r.block * size // 8 + len(own)] = own
    return bits


def _dealt(docs: DataFrame) -> DataFrame:
    """``docs`` in as many partitions as cores take in two rounds, or fewer: each sends a sketch and counts of its own."""
    return docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, words, f) summed by all but f, as far as ``HELD`` of them reach."""
    held, size = [], 0

    def summed() -> pa.Table:
        return pa.Table.from_batches(held).group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"}).select(["lang", "phrase", "words", "f"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= HELD:
            whole = summed()
            held, size = whole.to_batches(), whole.num_rows
            if size >= HELD // 2:
                yield from whole.to_batches(max_chunksize=1 << 16)
                held, size = [], 0
    if held:
        yield from summed().to_batches(max_chunksize=1 << 16)


def _survivors(docs: DataFrame, pairs, longer, width: int) -> DataFrame:
    """lang, phrase, words, f: summed within a task (``_summed``); words 0: all words of the language."""
    sent = docs.sparkSession.sparkContext.broadcast((pairs, longer))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        kept = lambda k, found: _among(found, sent.value[k > 2], width)
        for part in _slices(batches):
            levels = _phrases(part, kept)
            langs, words, n = next(levels)
            lang, phrases, one = np.arange(len(langs)), pa.array([""] * len(langs), pa.string()), pa.scalar(" ")
            yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(np.zeros(len(langs), np.int32)), pa.array(n.astype(np.int64))], names=["lang", "phrase", "words", "f"])
            place = np.arange(len(langs))  # of a phrase of the last length among those held
            for k, (_, times, before, last, use) in enumerate(levels, 1):
                own, end = place[before[use]], words.take(pa.array(last[use]))
                phrases = end if k == 1 else pc.binary_join_element_wise(phrases.take(pa.array(own)), end, one)
                lang = lang[own]
                place = np.cumsum(use) - 1
                if use.any():
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), phrases, pa.array(np.full(len(lang), k, np.int32)), pa.array(times[use].astype(np.int64))], names=["lang", "phrase", "words", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(found(batches))

    return docs.mapInArrow(count, "lang string, phrase string, words int, f long")


def width_for(size: int, least: int) -> int:
    """Counters in a row of the sketch for ``size`` bytes of text: about four for each phrase that could be frequent, as far
    as a task can hold them (100 MB)."""
    return min(MOST_WIDTH, max(BLOCK, 1 << max(0, 4 * size // max(1, least)).bit_length()))


def mine(docs: DataFrame, least: int = 100, most: int = 2000, within: int = 100, width: int | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of two to five words of each language.

    A-Z are lower-cased; texts part at ``.,;:!?`` and line ends into pieces, pieces at spaces and tabs into words. ``a`` is
    how often the phrase stands within pieces (overlaps count), ``n`` how many words the language has. A phrase with
    ``a >= least`` is cut where 1000 * a * n / (l * r) is lowest (l, r: counts of the two parts; ties: the first cut),
    which, rounded down, is its score; it goes if a longer one that holds it has ``within`` percent of its count or more.
    Ranks go by score, then a, both from the highest, then by the phrase's bytes. A null text is empty, a null language
    is "und"; repeated rows count each; other columns are ignored. No words give no rows.
    """
    docs = docs.select(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    if width is None:
        width = width_for(docs.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0, least)
    docs = _dealt(docs)
    pairs = _sketch(docs, width, least)
    counts = _survivors(docs, pairs, _sketch(docs, width, least, pairs), width).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))
    counts = stored(counts, "counts")
    return _ranked(_scored(counts, within), most)


def _part(a: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("w", a, n), " ")


def _scored(counts: DataFrame, within: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of what is in no longer phrase as frequent.

    A longer phrase one word longer is enough to look at: if one of more words holds it, so does a part of that, which is at
    least as frequent.
    """
    held = counts.where("words > 1").withColumn("w", F.split("phrase", " ", -1))
    rest = F.col("words") - 1
    longer = held.where("words > 2").select("lang", F.explode(F.array(_part(1, rest), _part(2, rest))).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = held.join(longer.hint("merge"), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * within))
    cut = F.col("cut")
    cuts = alone.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), rest)).alias("cut")).select("lang", "phrase", "a", "cut", _part(1, cut).alias("one"), _part(cut + 1, F.col("words") - cut).alias("two"))
    for side, name in (("one", "l"), ("two", "r")):
        cuts = cuts.join(counts.where("words > 0").select("lang", F.col("phrase").alias(side), F.col("f").alias(name)).hint("merge"), ["lang", side])
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))  # one row for each language
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)"), whole("l") * whole("r"))
    best = cuts.join(total, "lang").withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def _ranked(scored: DataFrame, most: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    at = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")
    near = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = near.withColumn("rank", at("lang", "salt")).where(F.col("rank") <= most).drop("salt")
    return near.withColumn("rank", at("lang")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
