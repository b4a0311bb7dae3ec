"""Stages of the corpus pipeline: each takes documents and gives documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, dedup, langid, quality
from .store import materialise


def language_id(docs: DataFrame) -> DataFrame:
    """Drop documents that language identification rejects."""
    return langid.keep_identified(docs)


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    return quality.keep_good(docs, labels)


def one_of_each_group(docs: DataFrame, params: dedup.Params | None = None) -> DataFrame:
    """Keep of each group of near duplicates the row with the smallest id.

    Of several rows of one id one stays (rows without id are never linked and
    all stay).  Only ids are gathered; texts stay where they lie unless the ids
    to drop are too many to broadcast, when both sides are shuffled by id.
    """
    found = materialise(dedup.near_duplicates(docs, params).select("doc_id", "kept"), "verdicts")
    drop = found.where("not kept").select("doc_id").distinct()
    rest = docs.join(drop, "doc_id", "left_anti").select(docs.columns)
    twice = materialise(found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc_id"), "repeated")
    if twice.isEmpty():
        return rest
    single = rest.join(twice, "doc_id", "left_anti").select(docs.columns)
    return single.unionByName(rest.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drop documents that are contaminated by benchmark items."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return decontam.verdicts(decontam.find_windows(rows, benchmark)).where(~F.col("contaminated")).select("row.*")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Add token_ids (little-endian unsigned 32-bit), n_tokens, and whether decoding gives the text back."""
    out = bpe.encode_decode(docs, ranks_path, pattern)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    n = F.expr("cast(octet_length(token_ids) div 4 as bigint)")
    return out.select(*docs.drop("token_ids", "n_tokens", "round_trip").columns, "token_ids", n.alias("n_tokens"), same.alias("round_trip"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
