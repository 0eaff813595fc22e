"""Training sequences from documents: language, near duplicates, repeated passages, mix, packing.

A stage gets what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerolith.llm import lang_id, minhash, mixing, packing, suffix_dedup
from aerolith.llm.common import drop, settled, table


#: Languages that are kept; None: all that are learned.
LANGUAGES: list[str] | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a wanted language, by prediction (which becomes their lang)."""
    return lang_id.stage(docs, LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.stage(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that occur earlier."""
    return suffix_dedup.stage(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order."""
    return mixing.stage(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, stretch by stretch of the training order."""
    return packing.stage(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixed", mixed), ("packed", packed)]
#: SQL can express neither n-gram profiles nor the sketches, suffix arrays and tokenisers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last = docs
        docs = settled(spark, lambda: stage(spark, last, sf_dir), f"pipeline-{name}")  # noqa: B023
        drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
