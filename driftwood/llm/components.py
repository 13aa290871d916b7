"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import drop, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u goes to the least of u and its neighbours; edges point down (src > dst), here and in the result."""
    least = materialize(edges.groupBy("src").agg(F.min("dst").alias("m")).withColumnRenamed("src", "dst"))
    return edges.join(least, "dst", "left").select("src", F.coalesce("m", "dst").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below u, and u itself, go to the least of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has either one edge down or none, and no edge leads to a node with an edge down."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): component is the least id reachable; a row for every id that has an edge to a smaller component.

    Edges meet the least neighbour of their lower end, which may be a hub, in a join with a written table, which AQE can
    split; after that step a node has about as many edges down as it had, and a hub has few.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    edges = materialize(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("src"), F.least(a, b).cast("long").alias("dst")).distinct())
    while not _are_stars(edges):
        large = materialize(_large_star(edges))
        new = materialize(_small_star(large))
        drop(edges)
        drop(large)
        edges = new
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
