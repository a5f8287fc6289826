"""A corpus pipeline of five operators; each stage's result is written and read again by the next.

Stages, in order: quality rules (rejected documents go), exact duplicates (the largest id of each
group stays), near-duplicates (one document of each class stays), personal data (replaced by
surrogates), packing into sequences of 2048 tokens (the last stage returns pieces, not documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marksheet.llm.bagminhash import drop_near_duplicates
from marksheet.llm.common import saved
from marksheet.llm.exacthash import drop_exact_duplicates
from marksheet.llm.packing import pack_documents
from marksheet.llm.queries import SURROGATE_KEY
from marksheet.llm.rules import with_verdict
from marksheet.llm.surrogate import pseudonymise

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table."""
    docs = docs.select(*COLUMNS)
    return with_verdict(docs).where("kept").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return drop_exact_duplicates(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the largest id."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars counts the new text."""
    out = pseudonymise(docs.select(*COLUMNS), SURROGATE_KEY)
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", personal), ("packing", packing)]

#: Near-duplicate classes, keyed surrogates and packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
