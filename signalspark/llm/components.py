"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of these. ``edges`` have the larger end as ``a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = F.when(F.col("b") != F.col("m"), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    own = F.struct("a", F.col("m").alias("b"))
    return edges.join(least, "a").select(F.inline(F.array_compact(F.array(own, moved)))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end of the distinct ``edges`` has one edge only, and none at which it is the smaller."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return nodes.where("up > 0 and n > 1").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges`` (two columns of one
    orderable type), component being the smallest node reachable.

    Alternates large-star and small-star contraction until the edges are stars, a number of
    rounds logarithmic in the longest chain. Minima are combined before each shuffle, so a hub
    never has its neighbours gathered in one row. A round has six stages, as every task of each is
    an event that the driver keeps: both directions come from one reading, and edges that repeat
    are dropped at its end only. Loops, repeated edges and edges with a null end add nothing; no
    edges give no rows.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        edges = checkpointed(_small_star(_large_star(edges)))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
