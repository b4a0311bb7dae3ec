"""Incremental duplicate removal over a stream of snapshots.

An extension: pages that arrive late or twice within the watermark are dropped
by content hash.  State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash


def dedupe_stream(snapshots: DataFrame, event_time: str, delay: str = "1 hour", body: str = "text") -> DataFrame:
    """First row of each content hash within ``delay`` of event time."""
    return snapshots.withColumn("content_hash", content_hash(F.col(body))).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(events: DataFrame, event_time: str, width: str = "10 minutes", delay: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Rows per tumbling window and kind, late rows counted within ``delay``."""
    return events.withWatermark(event_time, delay).groupBy(F.window(event_time, width), by).agg(F.count(F.lit(1)).alias("n"))
