"""Token counts kept as delta-maintained rollups.

A change is an insert (+count, +1 document), a delete (-count, -1) or a revised
count (new - old).  A batch of changes is summed by source, language and
tokenizer version, with partial sums before the shuffle, and written beside the
store; one rename commits it under its batch id.  A batch that is committed
already, or is sent again, changes nothing.  Totals are the sums of all
committed batches; :meth:`Rollup.compact` folds them into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec
from .store import small_batches
from .tokenbin import encoder, id_width
from .words import slices

#: Longest span that is encoded without halving where only the number of tokens is wanted.
LEAF = 4096

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, tokens long, documents long, batch string"


def count_tokens(docs: DataFrame, versions: dict[str, tuple]) -> DataFrame:
    """Add an array of counts, one per version in order of name, as ``n_tokens``.

    ``versions``: name to ``("ranks", path, pattern)`` or ``("word", path)``.
    Null text has no tokens.
    """
    small_batches(docs.sparkSession)
    names = sorted(versions)
    docs = docs.drop("n_tokens") if "n_tokens" in docs.columns else docs
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = []
        for v in names:
            kind, path, *rest = versions[v]
            if kind == "ranks":
                count.append(lambda x, c=codec(path, *rest, leaf_chars=LEAF): len(c.encode(x)))
            else:
                w = id_width(path)
                count.append(lambda x, e=encoder(path, w), w=w: len(e.encode(x)) // w)
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[c(x or "") for c in count] for x in texts], pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add ``rows(source, lang, version, n)``."""
    return rows.select(*KEYS, F.col("n").alias("tokens"), F.lit(1).cast("long").alias("documents"))


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take ``rows(source, lang, version, n)`` away."""
    return rows.select(*KEYS, (-F.col("n")).alias("tokens"), F.lit(-1).cast("long").alias("documents"))


def revisions(rows: DataFrame) -> DataFrame:
    """Changes of counts: ``rows(source, lang, version, n_old, n_new)``."""
    return rows.select(*KEYS, (F.col("n_new") - F.col("n_old")).alias("tokens"), F.lit(0).cast("long").alias("documents"))


class Rollup:
    """A store of committed batches in a folder (any file system that Spark writes to)."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Names of the committed batches."""
        root = self._path(self.uri)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` (source, lang, version, tokens, documents) once; False if ``batch`` is there already.

        Null counts count as 0; null keys are groups of their own.  An empty
        batch commits no rows, but its name.
        """
        if not batch or "/" in batch or "," in batch:
            raise ValueError("a batch needs a name without slash and comma")
        if any(batch in names.split(",") for names in self._names().values()):
            return False
        summed = changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.sum("documents"), F.lit(0)).cast("long").alias("documents"))
        return self._put(batch, summed.withColumn("batch", F.lit(batch)), batch)

    def _put(self, name: str, rows: DataFrame, batches: str) -> bool:
        staged = f"{self.uri}/.staged-{uuid.uuid4().hex}"
        rows.select(*KEYS, "tokens", "documents", "batch").write.parquet(staged)
        out = self._fs.create(self._path(f"{staged}/_batches"))
        out.write(bytearray(batches.encode()))
        out.close()
        to = self._path(f"{self.uri}/batch={name}")
        if self._fs.exists(to) or not self._fs.rename(self._path(staged), to):
            self._fs.delete(self._path(staged), True)
            return False
        return True

    def _names(self) -> dict[str, str]:
        """Of each stored folder the batches that it holds; a folded one supersedes those of its parts."""
        found = {}
        for n in self.committed():
            src = self._fs.open(self._path(f"{self.uri}/batch={n}/_batches"))
            found[n] = bytes(src.readAllBytes()).decode()
            src.close()
        return found

    def _live(self) -> list[str]:
        names = self._names()
        held = {n: set(x.split(",")) for n, x in names.items()}
        return [n for n in names if not any(held[n] < held[m] for m in names)]

    def deltas(self) -> DataFrame:
        """Rows of all committed batches."""
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.uri}/batch={n}" for n in live])

    def compact(self) -> None:
        """Fold all committed batches into one, which still knows their names."""
        live, names = self._live(), self._names()
        if len(live) > 1:
            every = ",".join(sorted({b for n in live for b in names[n].split(",")}))
            name = f"folded-{uuid.uuid4().hex}"
            rows = self.deltas().groupBy(*KEYS).agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents")).withColumn("batch", F.lit(name))
            if self._put(name, rows, every):
                for n in live:
                    self._fs.delete(self._path(f"{self.uri}/batch={n}"), True)

    def totals(self) -> DataFrame:
        """Sums by source, lang and version, and over sources, languages and both.

        ``level`` names the columns that a row stands for, so that null keys and
        totals are not confused.  Groups whose sums are all zero are left out.
        """
        sets = (KEYS, ("source", "version"), ("lang", "version"), ("version",))
        base = self.deltas().groupBy(*KEYS).agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
        level = F.when(F.grouping_id() == 0, ",".join(sets[0])).when(F.grouping_id() == 2, ",".join(sets[1])).when(F.grouping_id() == 4, ",".join(sets[2])).otherwise(sets[3][0])
        g = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in KEYS]).agg(level.alias("level"), F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
        return g.where("tokens <> 0 or documents <> 0").select("level", *KEYS, "tokens", "documents")
