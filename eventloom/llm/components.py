"""Connected components of an edge list by alternating large-star and small-star.

Each operation sends every edge to its node's smallest neighbour; the two together reach stars in a
logarithmic number of rounds.  Minima are combined before each shuffle and joined back, so no node's
neighbours meet in one task (Spark splits the rows of a hub in the joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm._base import discard, written


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hide that ``df`` is already dealt out by ``key``: a join then deals both sides anew and can split hot keys."""
    return df.withColumn(key, F.expr(f"{key} + 0"))


def _least_neighbours(edges: DataFrame) -> DataFrame:
    return spread(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = _least_neighbours(both).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbours(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def alternation(edges: DataFrame, files: int | None = None) -> DataFrame:
    """One large-star and one small-star of edges ``u, v`` (u > v); the components stay the same."""
    return written(_small_star(_large_star(edges)).distinct(), "edges", files)


def _are_stars(edges: DataFrame) -> bool:
    """Does every node that points at another point at one only, at which nothing points from above?"""
    pointing = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    chained = pointing.where("n > 1").select("u").union(edges.select(F.col("v").alias("u")).distinct().join(spread(pointing.select("u"), "u"), "u", "left_semi"))
    return chained.isEmpty()


def stars(edges: DataFrame, files: int | None = None) -> DataFrame:
    """Edges ``u, v`` (u > v) from each node to the smallest of its component: alternations, written to so many files, until they are stars.

    Stars stay as they are under both operations, and anything else changes.
    """
    given = edges
    while not _are_stars(edges):
        last, edges = edges, alternation(edges, files)
        if last is not given:
            discard(last)
    return edges


def oriented(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` as ``u, v`` with u > v; self-loops and edges with a null end link nothing."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for each node of the edges ``a, b`` (long).

    A node without an edge to another one does not appear.
    """
    found = stars(written(oriented(edges), "edges"))
    return found.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(found.select("v", "v").distinct())
