"""From raw documents to token ids, in five stages.

Each stage takes the documents that its predecessor kept, written as Parquet and
read again, and decides over all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from siftloom.llm import stages
from siftloom.llm.store import materialise


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.language_id(docs)


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.quality_filter(docs, stages.table(spark, sf_dir, "labels"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each_group(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.decontaminate(docs, stages.table(spark, sf_dir, "benchmark"))


def _byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", _language_id),
    ("quality", _quality),
    ("near_dedup", _near_dedup),
    ("decontaminate", _decontaminate),
    ("byte_bpe", _byte_bpe),
]

#: Trained classifiers, MinHash and BPE are beyond SQL; tests hold the rows against the single operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table ``documents``."""
    docs = stages.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
