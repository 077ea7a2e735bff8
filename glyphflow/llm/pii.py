"""Personal data: fixed patterns and assignments as seeds, and contexts that Spark learns from them.

Four kinds of identifiers have patterns of their own (``KINDS``). Their matches seed a bootstrap, as whole spans. So do
long tokens of letters and digits that something is assigned to (``ASSIGNED``: a key, = or :, maybe a quote), as far
as their surroundings turn out to be a pattern. A *candidate* is a run of identifier characters with a digit; its
*contexts* are the last one to three words before it and the first one or two after it (what stands between spaces,
whole), each with the candidate's make-up (which classes of characters, how long), and those of two words and more
before it also without. Contexts and candidates form a bipartite graph. In each round a context is believed by the
share of its distinct candidates that are known, if enough are; a candidate becomes known if the contexts that vouch
for it leave little doubt (noisy or). Rounds go on until nothing becomes known any more. What contexts vouch for and
isn't part of a fixed match is reported as kind ``id``; an assigned token that stands alone isn't.

Everything is DataFrame functions. Positions come from splitting a text at the same pattern that extracts the
matches: a match starts where the pieces and matches before it end. The patterns are possessive and anchored to
where a run of their characters begins, or to the end of the last match, which finds what the plain pattern finds in
time that is linear in the text. Texts without digit or @ are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm._common import discard, stored

#: Kinds in their order, with patterns.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![A-Za-z0-9._%+@/#-])[A-Za-z._%+@/#-]*+[0-9][A-Za-z0-9._%+@/#-]*+"
#: What stands before a value that is assigned: the last words, joined by single spaces.
ASSIGNED = r"(?:^|[\s{,;(\[])[\"']?[A-Za-z_][A-Za-z0-9_.-]*[\"']? ?[:=] ?[\"']?$"
SECRET = 16  # characters of an assigned token from which it is a seed
LEFT, RIGHT = (2, 3, 4), (1, 2)  # pieces between spaces; the one next to the candidate counts, empty or not
SPAN = "array<struct<kind:string,start:long,end:long>>"


MATCH = "array<struct<start:long,end:long,s:string,before:string,after:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often and in whatever lambda the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end, s, before, after): matches in code points, end exclusive, with the texts around them."""
    empty = F.expr(f"cast(array() as {MATCH})")

    def place(at: Column, p: Column) -> Column:
        start = at + F.length(p["before"])
        return F.struct(start.alias("start"), (start + F.length(p["s"])).alias("end"), p["s"].alias("s"), p["before"].alias("before"), p["after"].alias("after"))

    def step(done: Column, p: Column) -> Column:
        at = F.when(F.size(done) > 0, F.element_at(done, -1)["end"]).otherwise(F.lit(0).cast("long"))
        return F.concat(done, F.array(place(at, p)))

    # a fold that appends copies what it has, so it runs over slices of 64 matches, which are shifted afterwards
    def shift(acc: Column, part: Column) -> Column:
        moved = F.transform(part, lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end"), m["s"].alias("s"), m["before"].alias("before"), m["after"].alias("after")))
        return F.struct((acc["at"] + F.element_at(part, -1)["end"]).alias("at"), F.concat(acc["parts"], F.array(moved)).alias("parts"))

    def placed(pairs: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / 64).cast("int")), lambda k: F.aggregate(F.slice(pairs, k * 64 + 1, 64), empty, step))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{MATCH}>)").alias("parts"))
        return F.aggregate(slices, start, shift, lambda acc: F.flatten(acc["parts"]))

    def read(v: Column) -> Column:
        pairs = F.transform(v["found"], lambda s, i: F.struct(s.alias("s"), F.get(v["pieces"], i).alias("before"), F.get(v["pieces"], i + 1).alias("after")))
        return F.when(F.size(v["found"]) > 0, _let(pairs, placed)).otherwise(empty)

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces")), read)


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return s.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        back = F.split(F.reverse(digits), "")
        doubled = F.transform(back, lambda d, i: F.when(i % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.try_to_number(d, F.lit("9")).cast("int"))).otherwise(F.try_to_number(d, F.lit("9")).cast("int")))
        return F.length(digits).between(13, 19) & (F.aggregate(doubled, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array of (kind, start, end) by kind and start; no spans in a text without digit or @."""
    parts = []
    for kind, pattern in KINDS.items():
        parts.append(F.transform(F.filter(matches(text, pattern), _keeps(kind)), _named(kind)))
    return F.when(text.rlike("[0-9@]"), F.concat(*parts)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _keeps(kind: str):
    return lambda m: _valid(kind, m["s"])


def _named(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def _placed(rows: DataFrame, found: Column, seed: Column) -> DataFrame:
    """doc_id, h, start, end, inst, contexts, seed (base or assigned, else null): a row for each of ``found`` (matches)."""
    m = rows.select("doc_id", "h", "base", F.explode(found).alias("m")).withColumn("s", F.regexp_replace("m.s", "[._%+@/#-]+$", "")).where(F.length("s") >= 5)
    s = F.col("s")
    classes = F.concat(*[F.when(s.rlike(p), F.lit(c)).otherwise(F.lit("")) for c, p in (("9", "[0-9]"), ("a", "[a-z]"), ("A", "[A-Z]"), (".", r"\."), ("@", "@"), ("-", "-"), ("/", "/"), ("_", "_"))])
    make = F.concat_ws("~", classes, F.floor(F.log2(F.length(s).cast("double"))).cast("string"))
    before, after = F.split(F.lower("m.before"), r"\s+", -1), F.split(F.lower(F.concat(F.substr("m.s", F.length(s) + 1), F.col("m.after"))), r"\s+", -1)
    m = m.select("doc_id", "h", "base", F.col("m.start").alias("start"), (F.col("m.start") + F.length(s)).alias("end"), "s", make.alias("make"), F.slice(before, F.greatest(F.size(before) - max(LEFT) + 1, F.lit(1)), max(LEFT)).alias("l"), F.slice(after, 1, max(RIGHT)).alias("r"))
    last = lambda k: F.array_join(F.slice("l", F.greatest(F.size("l") - k + 1, F.lit(1)), k), " ")
    first = lambda k: F.array_join(F.slice("r", 1, k), " ")
    words = lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    told = [F.when(last(k) != "", F.xxhash64(F.lit("L"), last(k), "make")) for k in LEFT] + [F.when(F.trim(first(k)) != "", F.xxhash64(F.lit("R"), first(k), "make")) for k in RIGHT]
    told += [F.when(words(last(k)) >= 2, F.xxhash64(F.lit("W"), last(k))) for k in LEFT[1:]]
    contexts = F.array_distinct(F.filter(F.array(*told), lambda c: c.isNotNull()))
    return m.select("doc_id", "h", "start", "end", F.xxhash64("s").alias("inst"), contexts.alias("contexts"), seed.alias("seed"))


def _candidates(docs: DataFrame) -> DataFrame:
    """What ``_placed`` gives for the base spans and the candidates beside them of rows (doc_id, h, text, base)."""
    inside = F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    secret = (F.length("s") >= SECRET) & F.col("s").rlike("[A-Za-z]") & F.array_join("l", " ").rlike(ASSIGNED)
    own = _placed(docs.where(F.col("text").rlike("[0-9]")), matches(F.col("text"), CANDIDATE), F.when(inside, "within").when(secret, "assigned")).where("seed is null or seed <> 'within'")
    kinds = F.concat(*[F.filter(matches(F.col("text"), pattern), _keeps(kind)) for kind, pattern in KINDS.items()])
    return _placed(docs.where(F.size("base") > 0), kinds, F.lit("base")).union(own)


def discover(found: DataFrame, rounds: int | None = None, min_known: int = 4, min_share: float = 0.7, min_belief: float = 0.9) -> DataFrame:
    """inst of candidates that contexts vouch for, beside the base seeds, from rows of ``_candidates``.

    What is known only grows, so rounds end; they go on until nothing becomes known any more. With ``rounds`` given, an
    error is raised if that takes more of them.
    """
    graph = stored(found.select("inst", F.explode("contexts").alias("context")).distinct(), "graph")
    base = found.where("seed = 'base'").select("inst").distinct()
    known = stored(found.where("seed is not null").select("inst").distinct().withColumn("known", F.lit(True)), "known")
    n, told, done = known.count(), None, 0
    while True:
        if done == rounds:
            raise RuntimeError(f"after {rounds} rounds identifiers still become known")
        done += 1
        marked = graph.join(known, "inst", "left")
        believed = marked.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("k")).where((F.col("k") >= min_known) & (F.col("k") >= min_share * F.col("n")))
        belief = believed.select("context", F.log(1 - F.least(F.col("k") / F.col("n"), F.lit(0.99)) * (1 - F.pow(F.lit(2.0), -F.col("k")))).alias("doubt"))
        new = stored(graph.join(belief, "context").groupBy("inst").agg(F.min("doubt").alias("doubt")).where(F.col("doubt") <= F.log(F.lit(1 - min_belief))).select("inst"), "told")
        more = stored(known.select("inst").union(new).distinct().withColumn("known", F.lit(True)), "known")
        discard(known, told)
        known, told, was = more, new, n
        n = known.count()
        if n == was:
            break
    discard(known)
    return told.join(base, "inst", "left_anti")


def find(docs: DataFrame, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: one row per row of ``docs``; arrays of (kind, start, end) in code points, end exclusive.

    ``base`` holds the fixed matches by kind (in the order of KINDS) and start; ``spans`` goes on with those of kind
    "id". Null and empty texts have none; a null doc_id stays null; repeated rows get the same spans each; other
    columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text", base_spans(F.col("text")).alias("base"))
    found = stored(_candidates(rows), "candidates")
    fresh = found.where("seed is null or seed <> 'base'").join(discover(found, rounds), "inst").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("more"))
    out = rows.select("doc_id", "h", "base").alias("a").join(fresh.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")), "left")
    return out.select("a.doc_id", "base", F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {SPAN})"))).alias("spans"))


def spelt(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(by_start, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["at"] + 1).cast("int"))))).otherwise(text)


def redact(docs: DataFrame, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find`` masked in the text; columns, rows and texts without spans stay as they are.

    A null text stays null, an empty one empty; repeated rows are masked alike; no rows give no rows.
    """
    text = F.col(text_col).cast("string")
    plain = docs.withColumn("_h", F.xxhash64(F.coalesce(text, F.lit("")))).withColumn("_base", base_spans(F.coalesce(text, F.lit(""))))
    rows = plain.select(F.col(id_col).alias("doc_id"), F.col("_h").alias("h"), F.coalesce(text, F.lit("")).alias("text"), F.col("_base").alias("base"))
    found = stored(_candidates(rows), "candidates")
    fresh = found.where("seed is null or seed <> 'base'").join(discover(found, rounds), "inst").groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_g")).agg(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end")).alias("_more"))
    # only texts with digits can have spans that a context found, so the others needn't meet them
    with_digits = F.coalesce(text.rlike("[0-9]"), F.lit(False))
    met = plain.where(with_digits).join(fresh, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    done = lambda df, spans: df.select(*[masked(text, spans).alias(c) if c == text_col else F.col(c) for c in docs.columns])
    one = done(met, F.concat("_base", F.coalesce("_more", F.expr(f"cast(array() as {SPAN})"))))
    return one.unionByName(done(plain.where(~with_digits), F.col("_base")))
