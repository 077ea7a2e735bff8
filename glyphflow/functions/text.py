"""Text expressions: Column in, Column out, JVM-side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and scripts that write without spaces.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSPACED = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{0900}-\x{0dff}]"
#: Scripts of the language vote, first named first, with their ranges.
SCRIPTS = {"CH": r"[\x{4e00}-\x{9fff}]", "JP": r"[\x{3040}-\x{30ff}]", "KO": r"[\x{ac00}-\x{d7a3}]", "RU": r"[\x{0400}-\x{04ff}]", "EN": r"[\x{20}-\x{7e}]"}
OVERLAP = 6  # characters from which a text is long enough to be compared by containment


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, SPACE, "")


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}++$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(SPACE.replace("[", "[^", 1))


def canonical(body: Column, overlap: int = OVERLAP) -> Column:
    r"""Text for comparison: no line marks (\n, \N), no white space, no stray one-character line after enough text."""
    lines = F.transform(F.split(F.replace(body, F.lit("\r"), F.lit("")), r"\\[nN]", -1), squeeze)
    return F.aggregate(lines, F.lit(""), lambda done, z: F.when((F.length(z) == 1) & (F.length(done) >= overlap), done).otherwise(F.concat(done, z)))


def normalise_spaces(c: Column) -> Column:
    r"""Literal \n \r \t, line ends, tabs, no-break and ideographic spaces become single spaces."""
    return F.regexp_replace(F.regexp_replace(c, r"\\[nrt]|\r\n|[\r\n\t\x{a0}\x{3000}]", " "), " {2,}", " ")


def language(text: Column) -> Column:
    """Script vote: kana wins; else the most frequent script, ties to the one seen first; listed scripts absent, JP."""

    def vote(bare: Column) -> Column:
        first = lambda p: -F.coalesce(F.nullif(F.regexp_instr(bare, F.lit(p)), F.lit(0)), F.lit(2147483647))
        votes = [F.struct(F.regexp_count(bare, F.lit(p)).alias("n"), first(p).alias("first"), F.lit(k).alias("k")) for k, p in SCRIPTS.items() if k != "JP"]
        best = let(F.array_max(F.array(*votes)), lambda m: F.when(m["n"] == 0, "JP").otherwise(m["k"]))
        # most texts are ASCII alone, which no other script has a say in
        return F.when(bare == "", "EN").when(bare.rlike(r"^[\x20-\x7e]+$"), "EN").when(bare.rlike(SCRIPTS["JP"]), "JP").otherwise(best)

    return let(F.regexp_replace(text, r"""[ ,.!?'"(){}\[\]\p{Nd}-]""", ""), vote)


def word_count(text: Column) -> Column:
    """Characters of unspaced scripts plus words of the others."""
    rest = strip(F.regexp_replace(text, UNSPACED, " "))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.regexp_count(text, F.lit(UNSPACED)) + F.when(rest == "", 0).otherwise(F.size(F.split(rest, f"{SPACE}+", -1))))


def mainly_unspaced(text: Column, threshold: float = 0.5) -> Column:
    n = F.length(squeeze(text))
    return F.when(n > 0, F.regexp_count(text, F.lit(UNSPACED)) / n > threshold).otherwise(F.lit(False))


def is_noise(body: Column) -> Column:
    bare = squeeze(F.regexp_replace(F.replace(F.coalesce(body, F.lit("")), F.lit("\r"), F.lit("")), r"\\[nN]", ""))

    def noise(z: Column) -> Column:
        coded = z.rlike(r"^(?:[0-9]+[A-Za-z]+|[A-Za-z]+[0-9]+)$")
        return (
            F.when(z == "", True).when(z.rlike(r"^[()\[\]{}（）【】]+$"), True).when(z.rlike(r"^[0-9]+$"), True)
            .when(coded, F.length(z) <= 4).otherwise((F.length(z) == 1) & ~z.isin("，", "。", "！", "？", ".", "!", "?"))
        )

    return let(bare, noise)


def subsequence(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, or any smaller number if it is under ``least``.

    What both begin and end with is set aside. Of the rest, a row of the table is one integer, a bit for each character of
    the shorter text; rows stop where even matches to the end wouldn't reach ``least``.
    """
    if len(a) < len(b):
        a, b = b, a
    most, ends = len(b), 0
    while ends < most and a[ends] == b[ends]:
        ends += 1
    tail = 0
    while tail < most - ends and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b, same = a[ends : len(a) - tail], b[ends : len(b) - tail], ends + tail
    held: dict[str, int] = {}
    for j, y in enumerate(b):
        held[y] = held.get(y, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for i, x in enumerate(a):
        if u := v & held.get(x, 0):
            v = ((v + u) | (v - u)) & full
        if least and i % 64 == 63 and same + len(b) - v.bit_count() + len(a) - i - 1 < least:
            break
    return same + len(b) - v.bit_count()


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; null beside a null.

    A batch of pairs at a time: as expressions the table is an array for each character, interpreted, fifty times as slow.
    """
    @F.pandas_udf("int")
    def found(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else subsequence(p, q) for p, q in zip(x, y)], dtype="Int32")

    return found(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * common subsequence / total length; 1 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common_length(a, b) / total)


def alike(a: str, b: str, least: float) -> bool:
    """``bodies_similar`` of two strings: most pairs need no table, and a table is left where it can't reach ``least``."""
    if not a or not b:
        return False
    total = len(a) + len(b)
    if (a in b) if len(a) <= len(b) else (b in a):
        return True
    if 2.0 * min(len(a), len(b)) / total < least:
        return False
    return 2.0 * subsequence(a, b, int(least * total / 2)) / total >= least


def bodies_similar(a: Column, b: Column, least: float = 0.78) -> Column:
    """Of canonical texts: one contains the other, or the indel ratio is ``least`` or more; empty ones are like nothing.
    Null beside a null."""
    @F.pandas_udf("boolean")
    def found(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else alike(p, q, least) for p, q in zip(x, y)], dtype="boolean")

    return found(a, b)


#: Patterns of the semantic features.
PRICE = r"(?U)[¥￥$€£]\s*\d+|\d+\s*[元块]"
SPEAKER, DASH, QUOTE = r"^[A-Za-z\x{4e00}-\x{9fff}]{1,6}[:：]", "^(?:——|──)", "^[「『]"
SENTENCE_END, BANG = r"[。！？.!?…~]$", "[！!]$"
ADDRESS = r"[省市区县镇乡村路街巷号弄楼层室栋]|(?i:Road|Street|Avenue|District|Building|Room)"
SLOGAN = "欢迎|禁止|请勿|注意|安全|消防|紧急|出口|入口"


def semantic(text: Column) -> Column:
    """(text_length, line_count, ends_sentence, dialogue, proper_share, price, address, slogan) of a text, as one struct.

    The stripped text is computed once; a blank one has no features but its length and lines.
    """
    add = lambda c, x: F.when(c, x).otherwise(0.0)

    def read(t: Column) -> Column:
        told = lambda c: F.when(t == "", F.lit(False)).otherwise(c)
        dialogue = add(t.rlike(SPEAKER), 0.6) + add(t.rlike(DASH), 0.4) + add(F.startswith(t, F.lit('"')), 0.2) + add(t.rlike(QUOTE), 0.3)
        # counting by what is left when the others go is one pass over the text
        upper, digits = F.length(F.regexp_replace(t, r"[^\p{IsUppercase}]+", "")), F.length(F.regexp_replace(t, r"[^\p{Nd}\x{b2}\x{b3}\x{b9}]+", ""))
        return F.struct(
            F.length(text).alias("text_length"),
            (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("line_count"),
            told(t.rlike(SENTENCE_END)).alias("ends_sentence"),
            F.when(t == "", 0.0).otherwise(F.least(F.lit(1.0), dialogue)).alias("dialogue"),
            F.when(t == "", 0.0).otherwise((upper + 0.5 * digits) / F.length(t)).alias("proper_share"),
            told(t.rlike(PRICE)).alias("price"),
            told(t.rlike(ADDRESS)).alias("address"),
            told(t.rlike(SLOGAN) | ((F.length(t) >= 8) & t.rlike(BANG))).alias("slogan"),
        )

    return let(strip(text), read)


def semantic_score(f: Column) -> Column:
    """-1 (scene) to 1 (overlay) of a struct of ``semantic``."""
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    s = add(f["dialogue"] > 0.5, 0.4) + add(f["ends_sentence"] & (f["text_length"] < 50), 0.15) + add(f["price"], -0.3) + add(f["address"], -0.3) + add(f["slogan"], -0.2) + add(f["proper_share"] > 0.3, -0.2)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))
