"""Raw documents to packed training sequences, in five stages.

Each stage reads what the one before it wrote. A stage keeps all columns of documents; the last
returns pieces of documents with their places in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linksift.llm import decontamination, exact_dedup, near_dup, packing, quality
from linksift.llm.common import cut_lineage, documents, table
from linksift.llm.queries import vocabulary

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from their labels, accepts."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return quality.accepted(docs, machine, metadata=("n_chars",))


def exact_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with sequence and offset."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality), ("exact_dedup", exact_unique), ("near_dedup", near_unique), ("decontamination", clean_of_benchmark), ("packing", packed),
]

#: Training, hashing of words and tokenising are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
