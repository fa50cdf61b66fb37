"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def least_of(near: DataFrame) -> DataFrame:
    """The smallest neighbour m of each node. Written, so that a join with it deals both sides by key and a hot node's rows can be split."""
    return written(near.groupBy("a").agg(F.min("b").alias("m")), "least")


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour, itself included."""
    near = both_ways(edges)
    least = least_of(near).select("a", F.least("a", "m").alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. In edges, a > b."""
    least = least_of(edges)
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none: then the smaller one is the component."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node with a link; links has columns a and b.

    Alternates two steps that keep the components and lower the trees until every tree is a star; each step is two
    equi-joins on narrow rows, and a round ends in a written table, so a lost executor costs one round at most. A round
    that changes anything ties some node to a smaller one than before and none to a larger one, so rounds end; in
    practice after about the logarithm of the longest path.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        edges = written(small_star(written(large_star(edges), "large")), "edges")
        if stars(edges):
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
