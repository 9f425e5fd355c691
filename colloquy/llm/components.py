"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffled


def connected_components(links: DataFrame, saved: Callable[[DataFrame, str], DataFrame] = saved) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of
    ``links(a, b)``, both long; ``saved`` writes and rereads each round. Links are undirected; loops and repeats do
    no harm.

    Alternates two steps (the star contraction of Kiveris et al.) until every
    component is a star around its least node: hang the larger neighbours of
    every node on its smallest neighbour, then the smaller ones. Every step is
    an aggregate and a sort-merge join, so a node with any number of neighbours
    is never collected and nothing is broadcast by the driver; the number of
    rounds grows with the logarithm of the path lengths. Each round is saved,
    which keeps the lineage short."""
    def pairs(a: str, b: str) -> list:
        return [F.col(a).alias("a"), F.col(b).alias("b")]

    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(edges):
        # large star: each larger neighbour hangs on the least of all neighbours
        both = edges.union(edges.select(*pairs("b", "a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each smaller neighbour and the node itself hang on the least
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(shuffled(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        edges = saved(small, "stars")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether the distinct ``edges(a, b)``, a > b, are stars: every a hangs
    on one b, which hangs on nothing. A further round would change nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not degrees.agg(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0]
