"""Connected components of an edge table, by alternating large and small stars.

Every round hooks nodes to the smallest node they know, first among larger neighbours, then
among smaller ones, until the edges are stars around the smallest node of each component.  Rounds
are joins and minima with map-side combine; what a round leaves is written, so nothing is
recomputed, and no component is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node reachable.

    Loops and repeated edges are harmless; an empty table has no components.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    e = stored(e.distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(hooked.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
