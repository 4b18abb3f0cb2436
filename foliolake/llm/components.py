"""Connected components by alternating large-star and small-star.

Edges are rows; neighbourhoods are never gathered. A large-star step links
each larger neighbour of a node to the least node around it, a small-star
step links the smaller ones; the steps repeat until the edges, which then are
stars, stay as they are. The least neighbour of each node is written before
it is joined back, so both sides of the join are plain shuffles and a hub
with very many neighbours is one that adaptive execution splits.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, remove, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame, keep: Scratch) -> DataFrame:
    near = _both(edges)
    least = keep(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame, keep: Scratch) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end has one edge, to a node that is no larger end: further rounds change nothing."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u, v), written; root is the least node reachable.

    Null ends and loops are left out; an empty table gives an empty one.
    Raises if there are no stars after ``most`` rounds, which are far more
    than the logarithm of the edges that it takes.
    """
    now, path = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most):
        if _stars(now):
            break
        with Scratch() as keep:
            large = keep(large_star(now, keep), "large")
            then, to = stored(small_star(large, keep), "edges")
        remove(edges.sparkSession, path)
        now, path = then, to
    else:
        raise RuntimeError(f"no stars after {most} rounds")
    roots, _ = stored(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    remove(edges.sparkSession, path)
    return roots
