"""Duplicate removal by URL, canonical link and content hash.

Keep-first with one key is a ranking per key.  With several keys the rule is
sequential: a row is a duplicate if any *kept* earlier row shares a key, and a
rejected row's keys are forgotten.  ``greedy`` reaches the same result in
rounds of joins, however large a group is.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

MODES = ("canonical", "content_hash", "canonical_and_hash", "none")


def hash_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def url_key(c: Column) -> Column:
    return F.coalesce(urls.normalise(c), F.lower(c))


def keep_first(df: DataFrame, key: Column | list[Column], order: list) -> DataFrame:
    """The first row of each key by an explicit (ascending) order; null keys are one key.

    Every task keeps its own first rows before the shuffle, so a key with very
    many rows comes to its group as one row a task.
    """
    keys = key if isinstance(key, list) else [key]
    by = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    first = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*df.columns), by).alias("_row"))
    return first.select("_row.*")


def research_key(canonical: Column, content_hash: Column, url: Column) -> Column:
    return F.coalesce(canonical, content_hash, url)


def lead_key(website: Column, name: Column, location: Column) -> Column:
    none = F.lit("")
    return F.lower(F.trim(F.regexp_replace(F.concat_ws("|", F.coalesce(website, none), name, F.coalesce(location, none)), r"\s+", " ")))


_OWN: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        path = tempfile.mkdtemp(prefix="siftloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[sc.applicationId] = "file://" + path
    return _OWN[sc.applicationId]


#: Shuffle files of a write go once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_table(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Cut lineage: write to the folder in ``spark.checkpoint.dir`` and read back.

    Where that is unset, as in tests, one machine's temporary folder serves; with
    executors on other machines that is an error.  ``free``: the write's shuffle
    files go at its end.
    """
    spark: SparkSession = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_folder(spark)
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def page_keys(url: Column, canonical: Column, content_hash: Column, mode: str) -> dict[str, Column]:
    """The keys that count in a mode, in order of precedence."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "none":
        return {}
    keys = {"url": url_key(url)}
    if mode != "content_hash":
        keys["canonical"] = url_key(canonical)
    if mode != "canonical":
        keys["content_hash"] = hash_key(content_hash)
    return keys


def greedy(df: DataFrame, group: list[str], seq: str, keys: dict[str, Column], max_rounds: int = 200) -> DataFrame:
    """Add ``is_duplicate`` and ``matched_on`` by the sequential rule over ``seq`` within ``group``.

    Every round decides each row whose earlier neighbours (rows that share a key)
    are decided: it is dropped if one of them is kept, kept if all are dropped.
    Null keys match nothing.  ``seq`` must be unique within a group.
    """
    if not keys:
        return df.withColumn("is_duplicate", F.lit(False)).withColumn("matched_on", F.lit(None).cast("string"))
    names = list(keys)
    flat = df.select(*group, seq, F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(F.lit(f"{n}:"), keys[n]).alias("key")) for i, n in enumerate(names)])).alias("k"))
    flat = checkpoint_table(flat.select(*group, F.col(seq).alias("seq"), "k.rank", "k.key").where("key is not null"), "keys")
    on = [*group, "key"]
    state = df.select(*group, F.col(seq).alias("seq"), F.lit(0).alias("state"))  # 0 open, 1 kept, 2 dropped
    for _ in range(max_rounds):
        keyed = flat.join(state, [*group, "seq"])
        # per key: the first kept row, and the first row that is still open
        marks = keyed.groupBy(*on).agg(F.min(F.when(F.col("state") == 1, F.col("seq"))).alias("kept"), F.min(F.when(F.col("state") == 0, F.col("seq"))).alias("open"))
        seen = keyed.where("state = 0").join(marks, on).groupBy(*group, "seq").agg(F.max((F.coalesce(F.col("kept") < F.col("seq"), F.lit(False))).cast("int")).alias("hit"), F.max((F.coalesce(F.col("open") < F.col("seq"), F.lit(False))).cast("int")).alias("waits"))
        new = F.when(F.col("state") != 0, F.col("state")).when(F.col("hit") == 1, 2).when(F.coalesce("waits", F.lit(0)) == 0, 1).otherwise(0)
        state = checkpoint_table(state.join(seen, [*group, "seq"], "left").select(*group, "seq", new.alias("state")), "state")
        if state.where("state = 0").isEmpty():
            break
    else:
        raise RuntimeError("greedy dedupe did not settle")
    keyed = flat.join(state, [*group, "seq"])
    kept = keyed.where("state = 1").groupBy(*on).agg(F.min("seq").alias("kept"))
    match = keyed.where("state = 2").join(kept, on).where("kept < seq").groupBy(*group, "seq").agg(F.min("rank").alias("rank"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("rank") + 1)
    out = df.join(state.withColumnRenamed("seq", seq), [*group, seq]).join(match.withColumnRenamed("seq", seq), [*group, seq], "left")
    return out.withColumn("is_duplicate", F.col("state") == 2).withColumn("matched_on", F.when(F.col("rank").isNotNull(), name)).drop("state", "rank")


def dedupe_pages(df: DataFrame, mode: str = "canonical_and_hash", group: list[str] | None = None, seq: str = "seq", url: str = "url", canonical: str = "canonical_url", content_hash: str = "content_hash") -> DataFrame:
    """Page dedupe in one of four modes, per crawl (``group``) in order of ``seq``."""
    return greedy(df, group or [], seq, page_keys(F.col(url), F.col(canonical), F.col(content_hash), mode))
