"""Connected components of a graph whose edges are rows, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node that has an edge; root is the smallest node of its component.

    edges: one row per link between two long ids, in either order; repeated rows, self-links and rows
    with a null end are allowed (the last two are dropped). An empty table gives an empty table.
    Every round is two aggregations and two equi-joins on the node id; each round's star edges are
    checkpointed, so that the plan stays short and lost executors cost one round at most. The rounds grow
    with the logarithm of the number of nodes.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    stars = cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where((u != v) & u.isNotNull() & v.isNotNull()).distinct())
    state = _state(stars)
    while state[0]:
        stars = cut(_small_star(_large_star(stars)))
        now = _state(stars)
        if now == state:
            break
        state = now
    roots = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(stars: DataFrame) -> tuple[int, int]:
    row = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row.n, row.h


def _large_star(stars: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    moved = stars.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
