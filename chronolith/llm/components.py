"""Connected components of an edge list by alternating large and small stars.

Each round moves every node's neighbours to the smallest node that it sees, so hubs are never
gathered: a hub's rows take part in a count-like aggregate and in a join that adaptive execution can
split. Every round is written to the shared folder, which cuts lineage, and deletes the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _towards_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("__u"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.bitwise_not("u") == F.col("__u")).drop("__u")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node), for the nodes of edges (a, b) of longs; self-loops are ignored."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _towards_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, written(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        dropped(last)
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    # stars: every node but the smallest has one edge, to the smallest
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
