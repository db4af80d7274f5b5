"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.batches import drop, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours above (large) or below it (small) are hung on the least node of its neighbourhood.

    The least neighbour is a plain aggregate, so a node with any number of neighbours is never gathered.
    """
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    if large:
        both = both.union(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    else:
        both = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
    hung = both.join(least, "n")
    if large:
        out = hung.where("m > n").select(F.col("m").alias("a"), F.col("least").alias("b"))
    else:
        out = hung.where("m <> least").select(F.col("m").alias("a"), F.col("least").alias("b")).union(hung.select(F.col("n").alias("a"), F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each edge hangs a node (a) on a root (b): every a once, and no b also an a."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("hung"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("n").agg(F.sum("hung").alias("hung"), F.max("root").alias("root"))
    return per_node.where("hung + root > 1").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of an edge can reach. Nodes without an edge are not listed.

    Nulls and loops are ignored; edges may repeat and point either way. Each round is a written table; the number of
    rounds grows with the logarithm of the longest path.
    """
    ends = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(ends.distinct(), "edges")
    while not _are_stars(now):
        after = written(_star(_star(now, True), False), "edges")
        drop(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
