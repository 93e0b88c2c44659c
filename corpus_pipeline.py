"""A corpus from raw documents to token ids: five stages, each one operator of ``farelens.llm``.

Every stage reads what the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.llm import bpe, lines, minhash, mixing, quality
from farelens.llm.common import documents, stored
from farelens.llm.registry import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are outliers of their language and source go."""
    return quality.drop_rejected(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source share go; every document stays, n_chars follows."""
    cleaned = lines.drop_boilerplate(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return cleaned
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return minhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: left out, once, or repeated."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    coded = bpe.encode_and_decode(docs, tokenizer_path())
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", exact.alias("exact"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte-pair encoding", token_stage),
]

# Fitted outlier rules and byte-pair merges are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
