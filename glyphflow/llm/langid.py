"""Language identification as Bayesian fusion of text, markup, address and host.

Text: log likelihoods of character n-grams of 1 to 3 under a model for each language, tempered to the weight of
``WEIGHT`` n-grams, since n-grams of one text aren't independent. Markup and address: how often a declared language,
or a language code in the address (first path part, or top-level domain), goes with each language that texts show,
counted over all rows. Host: shares of languages on the host, smoothed towards those of its domain, and these
towards those of the whole table. A row's own vote is left out of every count. The posterior is their normalised product.

Models are fitted on at most ``MAX_TRAIN`` distinct labelled texts (the lowest hashes). All counts come from grouped
aggregation over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm._common import bounded_sample, folded, small_batches, stored
from glyphflow.llm._html import language_of, text_of

MAX_TRAIN, BITS, WEIGHT = 4000, 16, 60
TEXT = 1000.0  # n-grams that a training text counts for, however long it is
HOST_STRENGTH, DOMAIN_STRENGTH = 20.0, 50.0


def _grams(text: str):
    import numpy as np

    x = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.zeros(len(x), np.uint32)
    for k in range(3):
        h = (h[: len(x) - k] * np.uint32(0x01000193) ^ x[k:]) * np.uint32(0x9E3779B1)
        out.append((h ^ np.uint32(k)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, text_col: str = "text", lang_col: str = "lang"):
    """(languages, log shares as bytes of a float32 matrix of languages x 2**BITS).

    Texts are counted where they are drawn, whole and in parallel; what comes together is a vector of weights for each
    language and task, as integers, so that their order doesn't matter.
    """
    import numpy as np

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    rows = rows.select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    drawn = rows.join(F.broadcast(bounded_sample(rows.select("h"), "h", max_train)), "h").groupBy("h").agg(F.first("text").alias("text"), F.first("lang").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                own, grams = counts.setdefault(lang, np.zeros(1 << BITS, np.int64)), _grams(text.as_py())
                own += np.rint(np.bincount(grams, minlength=1 << BITS) * (1000 * TEXT / len(grams))).astype(np.int64)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([own.tobytes() for own in counts.values()], pa.binary())], names=["lang", "counts"])

    def add(group: pa.Table) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for lang, own in zip(group.column("lang").to_pylist(), group.column("counts")):
            total[lang] = total.get(lang, 0) + np.frombuffer(own.as_py(), np.int64)
        for lang, own in total.items():
            shares = np.log((own / 1000 + 0.1) / (own.sum() / 1000 + 0.1 * (1 << BITS))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([shares.tobytes()], pa.binary())], names=["lang", "shares"])

    counted = drawn.select("text", "lang").mapInArrow(run, "lang string, counts binary").select(F.xxhash64("lang").alias("k"), "lang", "counts")
    found = sorted((r.lang, bytes(r.shares)) for r in folded(counted, "k", add, "lang string, shares binary").collect())  # a row for each language
    return [lang for lang, _ in found], b"".join(shares for _, shares in found)


def _evidence(rows: DataFrame, model, html: bool) -> DataFrame:
    """id, h, host, declared, code, ll: from rows (id, h, text, url, host)."""
    langs, shares = model
    sent = rows.sparkSession.sparkContext.broadcast(shares)  # a matrix of fixed width for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from urllib.parse import urlsplit

        table = np.frombuffer(sent.value, np.float32).reshape(len(langs), 1 << BITS)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                hosts, declared, codes, lls = [], [], [], []
                for text, url, host in zip(*(part.column(k).to_pylist() for k in (2, 3, 4))):
                    lang = language_of(text) if html else None
                    text = text_of(text) if html else text or ""
                    try:
                        at = urlsplit(url or "")
                        host, path = host or (at.hostname or "").lower(), at.path.split("/")
                    except ValueError:
                        host, path = host or "", []
                    code = next((c for c in (path[1].lower() if len(path) > 1 else "", host.rpartition(".")[2]) if c in langs), None)
                    hosts.append(host)
                    declared.append(lang if lang is None or lang in langs else "other")
                    codes.append(code)
                    if any(c.isalpha() for c in text):
                        g = np.bincount(_grams(text), minlength=1 << BITS)
                        at = np.nonzero(g)[0]
                        ll = table[:, at] @ g[at]
                        ll *= min(1.0, WEIGHT / max(1, g.sum()))
                        lls.append((ll - ll.max()).astype(float).tolist())
                    else:
                        lls.append(None)
                cols = [part.column(0), part.column(1), pa.array(hosts), pa.array(declared, pa.string()), pa.array(codes, pa.string()), pa.array(lls, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "host", "declared", "code", "ll"])

    return rows.mapInArrow(run, "id long, h long, host string, declared string, code string, ll array<double>")


def _counted(rows: DataFrame, column: str, n: int) -> tuple[Column, list[float], int]:
    """(a map from each value of ``column`` to its votes by language, votes by language, values), over all rows. Values
    are few: languages and "other"."""
    found = {r[0]: list(r[1:]) for r in rows.where(F.col(column).isNotNull() & (F.col("vote") >= 0)).groupBy(column).agg(*[F.sum((F.col("vote") == i).cast("double")).alias(f"v{i}") for i in range(n)]).collect()}
    cells = [x for value, v in found.items() for x in (F.lit(value), F.array(*map(F.lit, v)))]
    return F.create_map(*cells) if cells else F.expr("cast(map() as map<string,array<double>>)"), [sum(v[i] for v in found.values()) for i in range(n)], len(found)


def identify(rows: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", url_col: str | None = None, host_col: str | None = None, html: bool = False, least: float = 0.5) -> DataFrame:
    """id, h (hash of the text), lang, confidence, text_lang, declared, host, rejected: one row per row.

    A row without any letter has no text evidence: its lang is "und" and it is rejected, as are rows whose best
    language has a posterior below ``least``, and every row if the model knows no language. Null ids stay null;
    null addresses and hosts are one host without name; repeated rows get the same result; other columns are ignored.
    """
    small_batches(rows.sparkSession)
    langs = model[0]
    n = len(langs)
    text = F.col(text_col).cast("string")
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), url.alias("url"), host.alias("host"))
    if not n:
        return plain.select("id", "h", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.coalesce("host", F.lit("")).alias("host"), F.lit(True).alias("rejected"))
    seen = stored(_evidence(plain, model, html).withColumn("vote", F.when(F.col("ll").isNotNull(), F.array_position("ll", F.array_max("ll")).cast("int") - 1).otherwise(F.lit(-1))), "evidence")
    by_markup, by_code = _counted(seen, "declared", n), _counted(seen, "code", n)
    votes = [F.sum((F.col("vote") == i).cast("double")).alias(f"v{i}") for i in range(n)]
    adds = lambda p: F.array(*[F.col(f"{p}{i}") for i in range(n)])
    hosts = seen.groupBy("host").agg(*votes).withColumn("domain", F.substring_index("host", ".", -2))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"v{i}").alias(f"d{i}") for i in range(n)])
    whole = hosts.agg(*[F.sum(f"v{i}") for i in range(n)]).first()
    whole = [(x or 0.0) + 1.0 for x in whole]
    shares = F.array(*[F.lit(x / sum(whole)) for x in whole])
    # a table of its own, so that the join can split a hot host
    near = stored(hosts.join(domains, "domain").select("host", adds("v").alias("on_host"), adds("d").alias("on_domain")), "hosts")
    met = seen.join(near, "host")
    less = lambda c: F.transform(c, lambda x, i: x - (F.col("vote") == i).cast("double"))  # noqa: E731  its own vote
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    met = met.withColumn("on_host", less("on_host")).withColumn("on_domain", less("on_domain"))
    met = met.withColumn("prior", F.zip_with("on_domain", shares, lambda c, g: (c + DOMAIN_STRENGTH * g) / (total(F.col("on_domain")) + DOMAIN_STRENGTH)))
    met = met.withColumn("prior", F.zip_with("on_host", "prior", lambda c, d: (c + HOST_STRENGTH * d) / (total(F.col("on_host")) + HOST_STRENGTH)))
    zero = F.array(*[F.lit(0.0)] * n)

    def part(counted: tuple[Column, list[float], int], c: str) -> Column:
        """log P(value | language), from all other rows."""
        by, total, values = counted
        own = lambda i: (F.col("vote") == i).cast("double")
        share = lambda x, i: F.log((x - own(i) + 1.0) / (F.get(F.array(*map(F.lit, total)), i) - own(i) + values + 1.0))
        return F.coalesce(F.transform(F.try_element_at(by, F.col(c)), share), zero)

    met = met.withColumn("p", F.zip_with(F.zip_with("ll", F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b), F.zip_with(part(by_markup, "declared"), part(by_code, "code"), lambda a, b: a + b), lambda a, b: a + b))
    met = met.withColumn("p", F.transform("p", lambda x: F.exp(x - F.array_max("p"))))
    names = F.array(*map(F.lit, langs))
    best = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    confidence = F.coalesce(F.array_max("p") / total(F.col("p")), F.lit(0.0))
    sure = F.col("ll").isNotNull() & (F.col("confidence") >= least)
    out = met.withColumn("confidence", confidence).withColumn("best", best)
    return out.select("id", "h", F.when(sure, F.get(names, F.col("best"))).otherwise("und").alias("lang"), "confidence", F.when(F.col("vote") >= 0, F.get(names, F.col("vote"))).otherwise("und").alias("text_lang"), "declared", "host", (~sure).alias("rejected"))


def keep_identified(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", few: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects; columns as they are. At most ``few`` rejects are broadcast.

    Null and empty texts, and those without letters, are rejected; rows go by their own text, so of rows with one doc_id
    each is judged for itself, a null doc_id among them; repeated rows go or stay together; no rows give no rows.
    """
    bad = identify(docs, model, id_col, text_col, host_col=host_col).where("rejected").select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct()
    if bad.limit(few + 1).count() <= few:
        bad = F.broadcast(bad)
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_h")), "left_anti")
