"""Chunks of texts: fixed windows in closed form, and windows over heading sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of structs (start, stop, text) of overlapping windows; blank windows are left out.

    The next window starts ``size - overlap`` on (one at least); the last one
    ends with the text.
    """
    stride = max(size - overlap, 1)
    n = F.length(text)
    count = F.when(n == 0, 0).otherwise(1 + F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(float(stride))).cast("int"))
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))
    cut = lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("stop"), F.trim(F.substring(text, s + 1, F.lit(size))).alias("text"))
    return F.filter(F.transform(starts, cut), lambda w: w["text"] != "")


def fixed_chunks(df: DataFrame, text_col: str, size: int = 1200, overlap: int = 150, max_chunks: int | None = None) -> DataFrame:
    """One row per window with chunk_no (from 1), start_char, end_char and chunk_text."""
    w = F.posexplode(windows(F.col(text_col), size, overlap)).alias("_i", "_w")
    out = df.select(*[c for c in df.columns if c != text_col], w)
    out = out.select(*[c for c in out.columns if c not in ("_i", "_w")], (F.col("_i") + 1).alias("chunk_no"), F.col("_w.start").alias("start_char"), F.col("_w.stop").alias("end_char"), F.col("_w.text").alias("chunk_text"))
    return out.where(F.col("chunk_no") <= max_chunks) if max_chunks else out


def section_chunks(df: DataFrame, key: list[str], sections_col: str = "sections", size: int = 1200, overlap: int = 150, max_chunks: int = 20) -> DataFrame:
    """Chunks of heading sections: key, chunk_id, heading_path, text, start_char, end_char.

    Offsets run on over the sections of a key, which count one more character
    each.  ``truncated`` is true for keys that reach ``max_chunks``.
    """
    s = df.select(*key, F.posexplode(sections_col).alias("sec", "s"))
    before = Window.partitionBy(*key).orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("base", F.coalesce(F.sum(F.length("s.text") + 1).over(before), F.lit(0)))
    c = s.select(*key, "sec", "base", F.col("s.heading_path").alias("heading_path"), F.posexplode(windows(F.col("s.text"), size, overlap)).alias("i", "w"))
    order = Window.partitionBy(*key).orderBy("sec", "i")
    c = c.withColumn("no", F.row_number().over(order)).where(F.col("no") <= max_chunks)
    full = F.max("no").over(Window.partitionBy(*key)) >= max_chunks
    return c.select(*key, F.concat(F.lit("chunk-"), F.col("no")).alias("chunk_id"), "heading_path", F.col("w.text").alias("text"), (F.col("base") + F.col("w.start")).alias("start_char"), (F.col("base") + F.col("w.stop")).alias("end_char"), full.alias("truncated"))
