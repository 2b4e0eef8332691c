"""The corpus pipeline: five operators over documents, each stage written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir), works on everything that the stage before it kept, and returns the columns of
documents (the last one: the encoded corpus).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilework.llm import common, minhash, mixing, paragraphs, quality, spans


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are depleted; takes lines above the limits out of the others."""
    return quality.apply_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.deduplicated(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in their first document only."""
    return paragraphs.without_repeats(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, a row per document of the mix."""
    return spans.digests(docs, spans.default_model())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing_to_weights", mixing_to_weights),
    ("piece_encoding", piece_encoding),
]

#: The near-duplicate and tokenizer stages can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
