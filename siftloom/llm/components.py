"""Connected components by alternating large-star and small-star rounds.

Only edges move: every round is two groupings of the edge list by vertex, and
its result is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each vertex's neighbours (larger ones if ``large``, else smaller ones) to its smallest."""
    both = edges.select(F.col("u").alias("v"), F.col("w").alias("n"))
    if large:
        both = both.unionByName(edges.select(F.col("w").alias("v"), F.col("u").alias("n")))
    # v > n in every edge (u > w), so for small stars v sees smaller neighbours only
    low = both.groupBy("v").agg(F.least(F.min("n"), F.col("v")).alias("m"))
    joined = both.join(low, "v")
    if large:
        out = joined.where(F.col("n") > F.col("v")).select(F.col("n").alias("u"), F.col("m").alias("w"))
    else:
        out = joined.select(F.col("n").alias("u"), F.col("m").alias("w")).unionByName(low.select(F.col("v").alias("u"), F.col("m").alias("w")))
    return out.where("u > w").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for every vertex with an edge.

    ``edges`` may repeat, point either way and hold loops; nulls are ignored.
    Converges in about log2 of the longest path's rounds; more than
    ``max_rounds`` is an error rather than a wrong result.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("w")).where("u > w").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        last, now = now, materialise(_star(_star(now, True), False), "edges")
        discard(last)
        # equal sums of a strong hash over equal counts: the edge set stands still
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            low = now.select(F.col("u").alias("vertex"), F.col("w").alias("component"))
            return low.unionByName(low.select(F.col("component").alias("vertex"), "component").distinct())
        seen = tuple(mark)
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")
