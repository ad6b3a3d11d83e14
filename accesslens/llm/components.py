"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.common import written


def is_star_forest(edges: DataFrame) -> bool:
    """Whether every node points at one other node at most and none of those points on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.filter("out > 1 or (out > 0 and into > 0)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, steps: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), a written table: root is the smallest node it is connected with.

    Each step points neighbours at the smallest node around them, so the number of steps is logarithmic in
    practice; none is made for edges that are stars around their smallest nodes. A large star gives no more
    edges than it gets, so repeated ones are only removed after the small star. Edges stay in tables that are
    written step by step; nodes with many edges are aggregated partially before they move.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(steps):
        if is_star_forest(edges):
            break
        # Large star: larger neighbours of a node point at the smallest one around it.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"), "edges")
        # Small star: smaller neighbours of a node, and itself, point at the smallest of them; the smallest one's edge is the node's own.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = written(edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
