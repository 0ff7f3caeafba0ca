"""Connected components of undirected edges by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node below it that has none itself: each component is a star then."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def _with_least(edges: DataFrame) -> DataFrame:
    """edges with m, the smallest b of their a. Least values are found in parts first, so that a node of many edges is no task's alone."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node links to the node's smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it link to the smallest of them."""
    return _with_least(edges).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b) but the smallest of each component.

    Rounds go on until all components are stars; their number grows as the logarithm of the nodes."""
    above = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(above, "edges")
    while not _stars_only(now):
        now = materialize(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
