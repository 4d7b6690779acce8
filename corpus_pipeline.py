"""A corpus pipeline over ``documents``, one written table per stage.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``, works on all rows that its
predecessor kept, and returns the columns of ``documents``; the last returns one
row per remaining document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import bpe_stream, exact_dedup, mixing, quality, shingle_join
from framewright.runtime import few_rows_a_batch, materialize

MIX_BUDGET = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    few_rows_a_batch(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of their five-word shingles in common) the row with the smallest id stays.

    The pivot distance tables of the SimHash operator propose pairs, whole shingle sets settle and complete them.
    """
    few_rows_a_batch(spark)
    return shingle_join.keep_first(docs, k=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities that keeps ``MIX_BUDGET`` of the tokens."""
    return mixing.sample_documents(docs, budget=MIX_BUDGET)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    import public_tokenizers

    few_rows_a_batch(spark)
    return bpe_stream.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", bpe_stage),
]

#: A fitted classifier and shingle hashes stand in the way of SQL; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
