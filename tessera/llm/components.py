"""Connected components of an edge table, by alternating star contraction.

Each round contracts the edges twice: every node hands its larger neighbours to its least neighbour (large
star), then every node hands its smaller neighbours to the least of them (small star).  Rounds grow with the
logarithm of the longest path.  The least neighbour is a partially aggregated ``min`` joined back on the node,
so a hub's edges are never gathered in a task: the join has a partitioning of its own, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Stored


def _star(pairs: DataFrame) -> DataFrame:
    """For (u, v): add m, the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # by another key, so that the join doesn't share the aggregation's partitions, which can't be split
    h = F.xxhash64("u").alias("h")
    return pairs.select("u", "v", h).join(least.select("u", "m", h), ["u", "h"]).drop("h")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hit = _star(both).filter("v > u")
    return hit.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hit = _star(down)
    out = hit.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(hit.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges(u, v)`` of longs in any order, repeats and loops allowed -> ``(node, root)``.

    root is the least node of the component; nodes without an edge to another don't appear; null ends are
    dropped.  The result reads a table in the shared folder.  An empty table gives an empty one.
    """
    spark = edges.sparkSession
    clean = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null and u <> v")
    now = Stored(spark, clean, "edges")
    mark = None
    for _ in range(max_rounds):
        after = Stored(spark, small_star(large_star(now.df)), "edges")
        now.drop()
        now = after
        seen = now.df.agg(F.count("u"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components: no fixpoint in {max_rounds} rounds")
