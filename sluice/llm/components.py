"""Connected components of a graph given as pairs of long ids, by alternating star contractions.

Each round links every vertex's larger neighbours to its least one (large star), then its smaller neighbours
(small star). Minima are pre-aggregated, and come back by a merge join whose skewed side can be split, so that a hub does
not gather in one task. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """Adds m: the least of u and its partners v."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least.hint("merge"), "u")


def connected(edges: DataFrame, *, most_rounds: int = 40) -> DataFrame:
    """(id, component) for each vertex of edges (u, v); the component is the least id in it. Loops are ignored."""
    at = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(most_rounds):
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        at = stored(small.filter("u <> v").distinct(), "edges")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return at.select(F.col("u").alias("id"), F.col("v").alias("component")).union(at.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
