"""A corpus pipeline of five stages, each an operator of passant.llm applied to all that the stage before it kept.

Each stage takes null in any column, empty and very long texts, rows that repeat and extra columns of any name; null text
counts as empty. What a stage decides holds for rows, not for all rows of a doc_id. An empty table stays empty.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns those columns for the rows that
stay; the last returns packed pieces. run() writes each stage's result as Parquet to the shared folder and reads it
again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passant.llm import mixing, near_texts, packing, quality, stream_dedup
from passant.llm.common import materialize, shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return stream_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose sets of five-word shingles are alike by 0.8 or more, the one with the
    smallest doc_id."""
    return near_texts.kept_rows(docs, words=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with probabilities calibrated to source, language and topic targets."""
    return mixing.kept_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no learned score, XXH64 or tokenizer; tests/llm/test_pipeline.py checks the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"{base}/{number}-{name}")
    return docs
