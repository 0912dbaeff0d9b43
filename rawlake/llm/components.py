"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rawlake.llm.common import stage


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a written table, and their number and a sum of their hashes, taken while writing."""
    seen = Observation()
    h = F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 31))
    held = stage(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")))
    return held, (seen.get["n"], seen.get["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node reachable.

    Alternating large and small stars: every node's neighbours are tied to the smallest node
    around it, until nothing changes. A node with very many edges is only ever aggregated or
    joined to one row. Each round is a written table.
    """
    held, before = _counted(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where(F.col("hi") != F.col("lo")).distinct())
    while before[0]:
        both = held.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(held.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        large = stage(large)
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        held, after = _counted(moved.union(small.select("hi", F.col("m").alias("lo"))).distinct())
        if after == before:
            break
        before = after
    return held.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        held.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
