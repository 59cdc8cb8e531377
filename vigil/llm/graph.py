"""Connected components by alternating large and small stars.

Every step is a grouped minimum (aggregated below the shuffle) and an
equi-join of two written tables, so a node with very many neighbours is split
by Spark's skew handling.  Nothing but an edge count and a checksum reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns a, b (any order, repeats and loops allowed);
    returns node, label (the smallest node of its component) for every node
    that has a link to another one."""
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "star")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
        large = stage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .where("u <> v").distinct(), "star")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "star")
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = stage(small, "star")
        before, state = state, _state(edges)
        if state == before:
            break
    # stars now: every edge leads to the centre
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
