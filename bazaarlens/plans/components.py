"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct edges (u, v), v < u, has one edge to a smaller node or only edges to larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.where("ups > 1 OR ups = 1 AND least = 0").count() == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; the component is its smallest node.

    Large-star / small-star rounds: each round hooks the neighbours of a node to the smallest one,
    so the rounds grow with the logarithm of the longest chain. The edges of a round are written to
    the shared folder. A hub's neighbours are reduced by ``min``, which Spark combines before the
    shuffle, and joined back, which AQE can split; no group is gathered in a task. Rounds end with the first
    that leaves only stars, since a next one would change nothing; edges that are stars already take one.
    Null ends and self loops are ignored; no edges give no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    if not e.count():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour points to the smallest node around u
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialize(e.where("u <> v").distinct(), "cc")
        if _are_stars(e):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
