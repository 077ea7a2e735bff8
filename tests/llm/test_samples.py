from pyspark.sql import functions as F

from glyphflow.llm import _common, langid, toxicity


def test_few_usable_rows(spark):
    """Rows that can't be used, and copies, don't count: the sample is full if there is enough."""
    rows = spark.range(20_000).select("id", F.xxhash64(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") % 200)).alias("h"))
    found = [r.h for r in _common.bounded_sample(rows, "h", 90).collect()]
    assert len(found) == len(set(found)) == 90


def test_languages(spark):
    """1 % of the rows have a language, and most of those are copies of one text."""
    lang = F.when(F.col("id") % 100 == 0, F.concat(F.lit("l"), (F.col("id") / 100 % 5).cast("int")))
    text = F.when(F.col("id") < 14_000, F.lit("hot text")).otherwise(F.concat(F.lit("text "), "id"))
    docs = spark.range(20_000).select(text.alias("text"), F.when(F.col("id") < 14_000, F.when(lang.isNotNull(), "l0")).otherwise(lang).alias("lang"))
    assert langid.fit(docs, max_train=40)[0] == ["l0", "l1", "l2", "l3", "l4"]


def test_labels(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "bounded_sample", lambda *a: seen.append(_common.bounded_sample(*a)) or seen[0])
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 100 == 0, (F.col("doc_id") / 100 % 2).cast("int")).alias("toxic"))
    toxicity.fit(docs, labels, max_train=40)
    assert seen[0].count() == 40
