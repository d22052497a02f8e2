"""Connected components of an edge list by alternating star contraction.

Every round replaces each node's edges by edges to the smallest neighbour, first for larger then
for smaller neighbours; components become stars around their smallest node in a number of rounds
logarithmic in their size. Rounds are cut by reliable checkpoints, and only a count and a
checksum of the edges come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import durable

MOST_ROUNDS = 60


def _to_least(pairs: DataFrame, keep_self: bool) -> DataFrame:
    """pairs (u, v): each v of u's list, and u itself if asked for, with the least of u and its list."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
    linked = pairs.join(least, F.col("u") == F.col("__u")).select("u", "v", "m")
    out = linked.where("v > u" if not keep_self else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep_self:
        out = out.unionByName(least.where("__u != m").select(F.col("__u").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node), for every node that has an edge."""
    larger, smaller = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    stars = durable(edges.where(F.col(a) != F.col(b)).select(larger, smaller).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, False)
        stars = durable(_to_least(large, True))
        found = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == mark or not found[0]:
            break
        mark = found
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
