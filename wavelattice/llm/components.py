"""Connected components of an edge table by alternating star contractions.

Every round joins each node's neighbours to its least neighbour; the result is
a star for each component. Rounds are stored in the shared folder. Nothing is
gathered on the driver but whether a round has left stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _stars(edges: DataFrame) -> DataFrame:
    """``edges``: distinct (a, b) with a > b. One contraction towards larger, then towards smaller nodes."""
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = edges.join(least.select(F.col("a").alias("b"), "m"), "b").select("a", "m")  # m <= b < a
    low = large.groupBy("a").agg(F.min("m").alias("least"))
    small = large.join(low, "a").filter("m <> least").select(F.col("m").alias("a"), F.col("least").alias("b"))
    return small.unionByName(low.select("a", F.col("least").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node either has one edge down or only edges up: the edges are stars then."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return node.filter("down > 1 OR (down = 1 AND up = 1)").limit(1).count() == 0


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(a, root) for every node of ``edges`` (a, b) that isn't its component's least node."""
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(edges.filter("a <> b").select(a, b).distinct(), small=True)
    for turn in range(rounds):
        if turn != 1 and _settled(edges):  # what one round leaves is seldom settled
            return edges.select("a", F.col("b").alias("root"))
        edges = stored(_stars(edges), small=True)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
