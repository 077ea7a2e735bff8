"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``glyphflow.llm``."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphflow.llm import decontam, langid, neardup, packing, pii
from glyphflow.llm._common import clear_since, standing, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those whose language stays open; the models come from ``docs`` itself.

    Null and empty texts go; repeated rows go or stay together; without any language nothing can be told and all rows go.
    """
    return langid.keep_identified(docs, langid.fit(docs)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group: five words a shingle, similarity 0.8 or more.

    Null and empty texts and rows without doc_id stay; rows of one doc_id are one document and stay or go together.
    """
    return neardup.deduplicate(docs, width=5).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth of the words or more.

    Each row goes by its own text; null and empty texts stay; an empty benchmark drops nothing.
    """
    return decontam.decontaminate(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks identifiers in the texts; n_chars follows. Null and empty texts stay as they are, and so do all rows."""
    masked = pii.redact(docs)
    return masked.selectExpr(*[f"cast(length(text) as {kind}) as n_chars" if c == "n_chars" else f"`{c}`" for c, kind in masked.dtypes])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: each row is a document, repeated ones too; a null text is empty and has its end token alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Tokens can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        before = [p for p in standing() if p != getattr(docs, "_stored_at", None)]
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        clear_since(spark, before, docs)  # what the stage was made from
    return STAGES[-1][1](spark, docs, sf_dir)
