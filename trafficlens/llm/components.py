"""Connected components of a graph that no single machine holds.

Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and
Beyond" (2014). Each step is a minimum by vertex, combined before the shuffle, and an equi-join, so a vertex
with very many edges is neither gathered in one row nor sent to the driver. Only the number of edges is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.util import checkpoint, dealt_anew


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex points its larger neighbours to the smallest vertex near it. Edges are (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(dealt_anew(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex points itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(dealt_anew(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for each vertex of `edges` (u, v: long), with component the smallest vertex
    reachable. Direction, repeats and self-loops don't matter; no edges give no rows."""
    now = checkpoint(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while True:
        after = checkpoint(_small_star(_large_star(now)))
        # Done when the edges are stars: every vertex has one parent, and no parent has a parent.
        several = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        deep = after.join(after.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").select("u")
        if several.unionByName(deep).isEmpty():
            break
        now = after
    centres = after.select("v").distinct().select(F.col("v").alias("vertex"), F.col("v").alias("component"))
    return after.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(centres)
