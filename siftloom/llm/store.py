"""Shared scratch space.

Tables that cut lineage and files that tasks exchange live below the folder
named by ``spark.checkpoint.dir``, the only one that the driver and all
executors of a cluster share.  Where the setting is absent a folder is made once
per session if the master is local (unit tests on one machine); else that is an
error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; set here only where the session has none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _OWN:
        path = tempfile.mkdtemp(prefix="siftloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[app] = "file://" + path
        sc.setCheckpointDir(_OWN[app])
    return _OWN[app]


#: Bytes of one Arrow batch that goes to a Python worker, where the session doesn't say.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound batches by bytes: by rows alone, long texts would make them huge.  A session's own setting stays."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new, unused URI below the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Shuffle files of one query go once it has ended (its result is on disk by then).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written.

    Unlike a cached frame it survives the loss of executors, and later readers
    start from the files instead of from the whole lineage.  The shuffle files
    of the write are freed at its end.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` once all that was made from them is written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Stored bytes that one range of a sort by id should hold.
RANGE_BYTES = 256 << 20


def ranges(df: DataFrame) -> int:
    """Partitions for a sort of ``df`` by ranges: from the bytes of the files that it reads, the shuffle setting at least.

    Sizes come from the plan's leaves, so nothing is read; leaves of unknown size (rows of the driver) count as none.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    stored = sum(x for x in sizes if x < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored // RANGE_BYTES), 1)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or bare path, else None."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` for a URI, used by tasks that write raw files."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path is not None else fs.FileSystem.from_uri(uri)


def write_atomic(uri: str, chunks) -> None:
    """Write byte chunks under a name of this attempt, then move them to ``uri``.

    Attempts of one task write equal bytes, so whichever moves last is right.
    """
    f, path = filesystem(uri)
    f.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with f.open_output_stream(part, compression=None) as out:
        for c in chunks:
            out.write(c)
    f.move(part, path)
