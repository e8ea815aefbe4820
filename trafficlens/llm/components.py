"""Connected components by alternating large-star and small-star steps.

Each step gives every node's neighbours to its smallest neighbour; after a
logarithmic number of rounds each component is a star around its smallest
node.  A step is a combining min per node and an equi-join with it, so a hub
with very many links is combined before the shuffle and its join side split by
Spark.  Every step is written to the shared folder, so lost executors cost at
most one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(e: DataFrame) -> DataFrame:
    around = e.select(F.col("v").alias("x"), F.col("u").alias("n")).union(e.select("u", "v"))
    least = around.groupBy("x").agg(F.min("n").alias("m"))
    return e.join(least, e["v"] == least["x"]).select("u", F.least("v", "m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links`` (pairs of longs) but the roots themselves; root: the smallest
    node reachable.  Null ends and links of a node with itself are left out."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = stored(pairs.where("u <> v").distinct(), "links")
    before = _state(e)
    while before[0]:
        e = stored(_small_star(stored(_large_star(e), "large-star")), "small-star")
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
