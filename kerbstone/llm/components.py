"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbstone.llm.common import settled


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the least of each vertex and its neighbours; partial per task, so hubs are no burden."""
    return edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour to the least vertex of the neighbourhood."""
    both = _both_ways(edges)
    larger = both.filter("b > a").join(_least(both), "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour, and the vertex itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every vertex of ``links`` that isn't the least of its component, and that least.

    Alternates large-star and small-star steps, a logarithmic number in practice, until no link changes.
    Each round is written to the shared folder, so none is redone when an executor is lost.
    """
    edges = settled(links.filter("a <> b").select("a", "b").distinct(), "links")
    state = None
    while True:
        found = edges.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        if found["n"] == 0 or (found["n"], found["x"]) == state:
            return edges
        state = (found["n"], found["x"])
        edges = settled(_small_star(_large_star(edges)), "links")
