"""The registered queries of this package, one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, dedup, fingerprint, langid, oracle, quality, rollup, suffixlm, tokenbin, warc
from .store import materialise, scratch


def _vocabulary(name: str) -> str:
    """A public vocabulary file on this machine (the same place on every worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"), dedup.Params(shingle=4))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents and pages, identified together; one of ``doc_id`` and ``page_id`` is null.

    The source of a document stands for its host; a page has its host, domain,
    markup language and address suffix.  The column ``lang`` labels the text
    model's sample and is no evidence of its row.
    """
    docs = _table(spark, sf_dir, "documents")
    p = langid.Params()
    langs, table = langid.train_text(docs, p)
    pages = langid.page_evidence(_table(spark, sf_dir, "pages"))
    rows = docs.select("doc_id", "text", F.col("source").alias("host")).unionByName(pages, allowMissingColumns=True)
    out = langid.identify(rows, ["doc_id", "page_id"], langs, table, p)
    return out.select("doc_id", "page_id", langid.held_out().alias("held_out"), "language", "confidence", "accepted")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = tokenbin.write_tokens(docs, _vocabulary("word_bpe_49k.json"), end_id=2)
    return tokenbin.read_crc(manifest)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(_table(spark, sf_dir, "documents"))


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixlm.score_documents(_table(spark, sf_dir, "documents"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), min_bytes=1000)
    return warc.resolve(warc.read_archives(manifest, payloads=False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.verdicts(decontam.find_windows(docs, _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, kept by batches.

    Batch ``load`` inserts every document under both tokenizers, the second with
    the first's counts; ``revised`` corrects those to its own; ``copies`` deletes,
    under both, rows whose text repeats that of a smaller id.  Each batch is sent
    twice, and the second time changes nothing.
    """
    import public_tokenizers

    versions = {"byte-bpe-multi-1": ("ranks", _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), "word-bpe-1": ("word", _vocabulary("word_bpe_49k.json"))}
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5("text").alias("digest"), "text")
    counted = materialise(rollup.count_tokens(docs, versions).drop("text"), "counts")
    both = counted.select("doc_id", "source", "lang", "digest", F.posexplode("n_tokens").alias("v", "n"), F.element_at("n_tokens", 1).alias("n_first"))
    both = both.withColumn("version", F.element_at(F.array(*[F.lit(x) for x in sorted(versions)]), F.col("v") + 1))
    # written, so that the join to the rows is of two plain exchanges, where Spark splits a text of many rows
    first = materialise(counted.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first")), "first")
    copies = both.join(first, "digest").where("doc_id > first")
    store = rollup.Rollup(spark, scratch(spark, "rollup"))
    for _ in range(2):
        store.commit("load", rollup.inserts(both.withColumn("n", F.col("n_first"))))
        store.commit("revised", rollup.revisions(both.where("v > 0").select("source", "lang", "version", F.col("n_first").alias("n_old"), F.col("n").alias("n_new"))))
        store.commit("copies", rollup.deletes(copies))
    return store.totals()


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffix_tree_scores": op6_suffix_tree_scores,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_rollup": op10_token_rollup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": oracle.NEAR_DUPLICATES,
    "op7_warc_revisits": oracle.WARC_REVISITS,
    "op9_decontaminate": oracle.DECONTAMINATION,
}
