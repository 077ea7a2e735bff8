"""The registered queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm import ann, chat, cohorts, collocations, curve, decontam, langid, licenses, neardup, packing, pii, toxicity, warc
from glyphflow.llm._common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.spelt(F.col("base")), 256).alias("base_sha256"), pii.spelt(F.col("spans")).alias("spans"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.withColumn("mask", mask)


OP5_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
m AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) - 1) // 4096 AS segment, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) AS turn, role, body FROM c),
p AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM m WHERE role <> 'system'),
s AS (SELECT conv_id, segment, max({'t': turn, 'b': body}) FILTER (role = 'system').b AS said FROM m GROUP BY 1, 2),
b AS (SELECT conv_id, segment, last_value(said IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS body FROM s),
a AS (SELECT *, 1 AS own_turn FROM m UNION ALL SELECT conv_id, segment, NULL, 'system', body, 0 FROM b WHERE body IS NOT NULL),
r AS (SELECT conv_id, segment, speaker, turn, own_turn, role, body, role = speaker AS own, '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') END || chr(10) AS head, body || '<|im_end|>' AS tail FROM a JOIN p ON conv_id IS NOT DISTINCT FROM c),
o AS (SELECT *, sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, segment, speaker ORDER BY own_turn, turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING) - length(tail) - 1 AS s FROM r)
SELECT conv_id, segment, speaker, CAST(sum(own_turn) AS BIGINT) AS n_turns, string_agg(head || tail || chr(10), '' ORDER BY own_turn, turn NULLS FIRST, role, body) AS text, coalesce(string_agg(CASE WHEN own THEN CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + length(tail) AS BIGINT) AS VARCHAR) END, ',' ORDER BY own_turn, turn NULLS FIRST, role, body), '') AS mask
FROM o GROUP BY conv_id, segment, speaker
"""


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents"))
    found = langid.identify(table(spark, sf_dir, "pages"), model, "page_id", "html", url_col="url", html=True)
    return found.select(F.col("id").alias("page_id"), "host", "declared", "text_lang", "lang", "confidence", "rejected")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return found.withColumn("block", F.decode("block", "UTF-8"))


def op11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, clients = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients")
    h = F.coalesce(F.crc32(F.col("click_id").cast("string")), F.lit(1))
    arrives = F.when(h % 3 == 0, F.col("arrived_at") + F.make_dt_interval((h % 100).cast("int"))).otherwise(F.col("arrived_at"))
    known = F.coalesce(arrives < F.lit("2024-02-15 00:00:00").cast("timestamp_ntz"), F.lit(False))
    first = cohorts.materialise(clicks.where(known), clients)
    return cohorts.matrix(first, cohorts.advance(first, clicks.where(~known)))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
    laid = curve.layout(docs, ["lang", "source", "size"], 16)
    return laid.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle; the smallest doc_id is passed along links.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u AS a JOIN u AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s AS x ON x.doc_id = a JOIN s AS y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT e.b, root FROM r JOIN e ON a = r.doc_id WHERE root < e.b),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM s JOIN c USING (doc_id)
"""


#: Words as in the query; windows of 13 words or the whole shorter item; occurrences by comparing each document window.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s FROM b, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0),
seen AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM d, (SELECT DISTINCT n FROM win), unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, seen.n, item_id FROM seen JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: The checksum, from its polynomial; the states, each worked out from all of its clicks.
OP11_SQL = """
WITH poly AS (SELECT list_transform(generate_series(0, 255), lambda n: list_reduce(generate_series(1, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n::BIGINT)) AS t),
ids AS (SELECT DISTINCT id, CAST(id AS VARCHAR) AS s FROM (SELECT click_id AS id FROM clicks UNION ALL SELECT client_id FROM clicks) WHERE id IS NOT NULL),
crc AS (SELECT id, xor(list_reduce(list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM ids, poly),
c AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
a AS (SELECT c.*, CASE WHEN h % 3 = 0 THEN arrived_at + to_days(CAST(h % 100 AS INTEGER)) ELSE arrived_at END AS arrives FROM c LEFT JOIN crc ON id = click_id),
k AS (SELECT n AS state, client_id, ts, kind, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents FROM a, (VALUES (0), (1)) AS v(n) WHERE n = 1 OR arrives < TIMESTAMP '2024-02-15 00:00:00'),
s AS (SELECT state, client_id, min(ts) AS start FROM k WHERE kind = 'signup' GROUP BY ALL),
m AS (SELECT client_id, count(DISTINCT CAST(start AS DATE)) > 1 AS moves FROM s GROUP BY ALL),
g AS (SELECT client_id, min(segment) AS segment FROM clients GROUP BY ALL),
r AS (SELECT state, client_id, coalesce(segment, '') AS segment, date_diff('day', DATE '1970-01-01', CAST(start AS DATE)) AS cohort, (epoch_us(ts) - epoch_us(start)) // 86400000000 AS period, moves, sum(cents) AS cents FROM k JOIN s USING (state, client_id) JOIN m USING (client_id) LEFT JOIN g USING (client_id) WHERE ts >= start GROUP BY ALL)
SELECT CAST(state AS INTEGER) AS state, segment, CAST(cohort AS BIGINT) AS cohort, CAST(period AS BIGINT) AS period, count(*) AS users, CAST(sum(h) AS BIGINT) AS users_crc32, CAST(sum(CAST(moves AS BIGINT)) AS BIGINT) AS moved, CAST(sum(cents) AS BIGINT) AS cents
FROM r JOIN crc ON id = client_id GROUP BY ALL
"""


#: Every phrase counted, every longer phrase looked at.
OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM w, (VALUES (1), (2), (3), (4), (5)) AS v(k), unnest(generate_series(1, len(w) - k + 1)) AS u(i) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
h AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT DISTINCT h.lang, array_to_string(list_slice(w, i, j), ' ') AS phrase, a AS longer FROM h, unnest(generate_series(1, k)) AS x(i), unnest(generate_series(i, k)) AS y(j) WHERE j - i + 1 < k),
alone AS (SELECT h.lang, h.k, h.phrase, h.a, h.w FROM h WHERE NOT EXISTS (SELECT 1 FROM inner_ z WHERE z.lang = h.lang AND z.phrase = h.phrase AND 100 * z.longer >= 100 * h.a)),
cuts AS (SELECT lang, phrase, a, c, array_to_string(list_slice(w, 1, c), ' ') AS one, array_to_string(list_slice(w, c + 1, k), ' ') AS two FROM alone, unnest(generate_series(1, k - 1)) AS x(c)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, c, b.a AS l, d.a AS r, n, (1000::HUGEINT * cuts.a * n) // (b.a::HUGEINT * d.a) AS score FROM cuts JOIN f b ON b.lang = cuts.lang AND b.phrase = one JOIN f d ON d.lang = cuts.lang AND d.phrase = two JOIN t ON t.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM best QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_near_duplicates": op2_near_duplicates, "op3_packing": op3_packing, "op4_pii": op4_pii, "op5_chat": op5_chat, "op6_licenses": op6_licenses, "op7_decontamination": op7_decontamination, "op8_language": op8_language, "op9_neighbours": op9_neighbours, "op10_warc": op10_warc, "op11_retention": op11_retention, "op12_sharding": op12_sharding, "op13_collocations": op13_collocations}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": OP2_SQL, "op5_chat": OP5_SQL, "op7_decontamination": OP7_SQL, "op11_retention": OP11_SQL, "op13_collocations": OP13_SQL}
