"""Benchmark decontamination: a broadcast set of normalised test n-grams against every window of training words.

Words are runs of characters outside ASCII punctuation, spaces and controls, with A-Z lower-cased. A benchmark item
of ``width`` words or more gives all its windows of ``width`` consecutive words; a shorter one is a single window.
A document word is *hit* if it lies in any occurrence of a window.

Everything is built from DataFrame functions. While the benchmark has at most ``max_windows`` windows, they travel
to the tasks as a literal hash set, and each document is scanned inside its row: three words of a window are looked
up in the benchmark's vocabulary first, and only then is the whole window spelt out and compared, so a hit is an
exact match. Scanning shuffles nothing. Of a larger benchmark only a bit for each window's three words is sent (a
filter of 16 bits a window, and 2 MB at most); document windows that pass it are spelt out and meet the benchmark's in
a join. Either way gives the same rows.

A document's words are bound once in its row (``_read``), so that no filter, however the optimiser moves it, splits a
text again for every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm._common import WORD_BREAK, ascii_lower

MAX_WINDOWS = 20_000
#: The filter that stands for a benchmark of more windows has ``2**BITS`` bits at most. Beyond a million windows more
#: passes it than is a hit; the join that follows tells.
BITS = 24
HITS = "array<struct<pos:int,len:int,window:string>>"


def words_of(text: Column) -> Column:
    """Words as they stand; null and wordless texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK, -1), "")


def benchmark_windows(benchmark: DataFrame, width: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, len, window (its words, lower-cased, joined by spaces); each once."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(ascii_lower(F.col(text_col).cast("string"))).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))).alias("at")
    return items.select("item_id", "w", at).select("item_id", F.least(F.size("w"), F.lit(width)).alias("len"), F.array_join(F.slice("w", F.col("at"), width), " ").alias("window")).distinct()


def _probes(n: int) -> list[int]:
    """Places of a window of n words that are looked up before it is spelt out."""
    return sorted({0, n // 2, n - 1})


def _read(docs: DataFrame, text: Column, hits: str, share: int) -> DataFrame:
    """Adds _r (n_words, n_hit, bad, hits) to each row. ``hits`` is SQL over the row's words _w."""
    empty = "named_struct('end', 0, 'n', 0)"
    covered = f"aggregate(_h, {empty}, (s, h) -> named_struct('end', greatest(s.end, h.pos + h.len), 'n', s.n + greatest(h.pos + h.len - greatest(s.end, h.pos), 0)), s -> s.n)"
    counted = f"named_struct('n_words', cast(size(_w) as bigint), 'n_hit', cast({covered} as bigint), 'hits', _h)"
    judged = f"transform(array({counted}), c -> named_struct('n_words', c.n_words, 'n_hit', c.n_hit, 'bad', c.n_hit > 0 and c.n_hit * {share} >= c.n_words, 'hits', c.hits))[0]"
    bound = f"transform(array(_words), _w -> transform(array({hits}), _h -> {judged})[0])[0]"
    return docs.withColumn("_words", words_of(ascii_lower(text))).withColumn("_r", F.expr(bound)).drop("_words")


def _literal(windows: list) -> str:
    """SQL for the hits (pos, len, window; by pos) among the words _w, with the windows as literals."""
    quoted = lambda strings: ",".join(f"'{s}'" for s in sorted(strings))  # noqa: E731  words hold no quotes or backslashes
    parts = []
    for n in sorted({r["len"] for r in windows}):
        own = [r["window"] for r in windows if r["len"] == n]
        vocabulary = quoted({w for x in own for w in x.split(" ")})
        probes = " and ".join(f"get(_w, i + {k}) in ({vocabulary})" for k in _probes(n))
        parts.append(_found(n, probes, quoted(own)))
    return _together(parts)


def _found(n: int, probes: str, own: str | None) -> str:
    spelt = f"array_join(slice(_w, i + 1, {n}), ' ')"
    check = f"{probes} and {spelt} in ({own})" if own else probes
    return f"if(size(_w) < {n}, array(), transform(filter(sequence(0, size(_w) - {n}), i -> {check}), i -> struct(i as pos, {n} as len, {spelt} as window)))"


def _together(parts: list[str]) -> str:
    if not parts:
        return f"cast(array() as {HITS})"
    return parts[0] if len(parts) == 1 else f"array_sort(concat({', '.join(parts)}))"


def _filtered(windows: DataFrame) -> str:
    """SQL for what may be hits among the words _w: the three words of each window are a bit of a filter of fixed size."""
    lens, parts = {r.len: r.n for r in windows.select("len", "window").distinct().groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}, []
    word = "cast(floor(at / 62) as int)"
    for n, held in sorted(lens.items()):
        bits = min(BITS, max(10, (16 * held - 1).bit_length()))
        key = lambda w, i: f"pmod(xxhash64({', '.join(f'get({w}, {i} + {k})' for k in _probes(n))}), {1 << bits})"
        at = windows.where(F.col("len") == n).select(F.split("window", " ").alias("w")).select(F.expr(key("w", "0")).alias("at"))
        cells = {r.word: r.bits for r in at.selectExpr(f"{word} as word", "shiftleft(1L, cast(at % 62 as int)) as bit").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).collect()}  # 2**bits / 62 rows at most
        filled = ",".join(str(cells.get(k, 0)) for k in range(((1 << bits) - 1) // 62 + 1))
        probe = f"transform(array({key('_w', 'i')}), at -> bit_get(get(from_json('[{filled}]', 'array<bigint>'), {word}), cast(at % 62 as int)) = 1)[0]"
        parts.append(_found(n, probe, None))
    return _together(parts)


def _verified(docs: DataFrame, windows: DataFrame, text: Column, share: int) -> DataFrame:
    """_text, _r: the texts of ``docs`` that hold a window, each once, with their true hits."""
    likely = _read(docs.select(text.alias("_text")).distinct(), F.col("_text"), _filtered(windows), share).where("size(_r.hits) > 0")
    met = likely.select("_text", F.explode("_r.hits").alias("h"), F.col("_r.n_words").alias("n_words")).select("_text", "n_words", "h.*").join(windows.select("window").distinct(), "window", "left_semi")
    true = met.groupBy("_text").agg(F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(F.struct("pos", "len", "window"))).alias("_h"))
    count = F.expr("cast(aggregate(_h, named_struct('end', 0, 'n', 0), (s, h) -> named_struct('end', greatest(s.end, h.pos + h.len), 'n', s.n + greatest(h.pos + h.len - greatest(s.end, h.pos), 0)), s -> s.n) as bigint)")
    true = true.withColumn("n_hit", count)
    return true.select("_text", F.struct("n_words", "n_hit", (F.col("n_hit") * share >= F.col("n_words")).alias("bad"), F.col("_h").alias("hits")).alias("_r"))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> tuple[DataFrame, DataFrame, bool]:
    """(windows, documents with _r, whether the windows and their items are few enough to be sent).

    _r holds n_words, n_hit, bad and hits (pos, len, window; by pos). A row goes by its own text.
    """
    windows, text = benchmark_windows(benchmark, width, item_col, item_text_col), F.col(text_col).cast("string")
    few = windows.select("len", "window").distinct().limit(max_windows + 1).collect()
    if len(few) <= max_windows:
        return windows, _read(docs, text, _literal(few), share), windows.limit(4 * max_windows + 1).count() <= 4 * max_windows
    none = _read(docs, text, _together([]), share)
    found = _verified(docs, windows, text, share).withColumnRenamed("_r", "_true")
    met = none.join(found, text == F.col("_text"), "left")
    return windows, met.withColumn("_r", F.coalesce("_true", "_r")).drop("_text", "_true"), False


def report(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings), contaminated (``share * n_hit >= n_words`` and a hit).

    One row per input row, repeated rows included. Null and empty texts have no words, no hits and aren't
    contaminated; null benchmark texts have no windows; an empty benchmark hits nothing; a null doc_id stays null;
    other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    windows, found, sent = scan(own, benchmark, width, share, "text", item_col, item_text_col, max_windows)
    # rows that are alike are one group and counted, so that the key holds however often a task runs
    narrow = found.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.col("_r.n_words").alias("n_words"), F.col("_r.n_hit").alias("n_hit"), F.col("_r.bad").alias("contaminated"), F.array_distinct("_r.hits.window").alias("ws"))
    rows = narrow.select("*", F.posexplode_outer("ws").alias("at", "window")).drop("ws")
    by = windows.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    if sent:
        met = rows.join(F.broadcast(by), "window", "left")
    else:  # rows without a hit meet nothing, each text by a key of its own
        met = rows.withColumn("window", F.coalesce("window", F.concat(F.lit("\n"), F.col("key").cast("string")))).join(by, "window", "left")
    copies = F.count_if(F.coalesce("at", F.lit(0)) == 0)
    out = met.groupBy("key", "doc_id", "n_words", "n_hit", "contaminated").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"), copies.alias("copies"))
    return out.select("doc_id", "n_words", "n_hit", "items", "contaminated", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents (action "documents") or without the hit words of any document ("spans").

    The columns stay as they are. In "spans", a word that goes takes the separator before it along. Documents
    without a hit, and with "documents" those whose hits stay below 1 in ``share`` words, are untouched. Each
    row goes by its own text, whatever its doc_id and however large the benchmark.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"no such action: {action}")
    _, judged, _ = scan(docs, benchmark, width, share, text_col, item_col, item_text_col, max_windows)
    if action == "documents":
        return judged.where("not _r.bad").select(docs.columns)
    judged = judged.withColumn("_hits", F.col("_r.hits"))
    merged = F.aggregate(
        "_hits",
        F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda s, h: F.when((F.size(s) > 0) & (F.element_at(s, -1)["b"] >= h["pos"]), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["a"].alias("a"), F.greatest(F.element_at(s, -1)["b"], h["pos"] + h["len"]).alias("b"))))).otherwise(F.concat(s, F.array(F.struct(h["pos"].alias("a"), (h["pos"] + h["len"]).alias("b"))))),
    )
    gaps = F.split(F.col(text_col), "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", -1)
    kept = F.array_join(F.transform(words_of(F.col(text_col)), lambda w, i: F.when(F.exists("_spans", lambda s: (s["a"] <= i) & (i < s["b"])), F.lit("")).otherwise(F.concat(F.get("_gaps", i), w))), "")
    cut = judged.withColumn("_spans", merged).withColumn("_gaps", F.when(F.size("_hits") > 0, gaps)).withColumn("_cut", F.when(F.size("_hits") > 0, F.concat(kept, F.element_at("_gaps", -1))).otherwise(F.col(text_col)))
    return cut.select(*[F.col("_cut").alias(c) if c == text_col else F.col(c) for c in docs.columns])
