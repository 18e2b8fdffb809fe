"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two group-bys and joins on the edge table; nothing is gathered on the driver but one
count a round. Rounds are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("m").alias("a"), "b")
    return moved.unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component, roots included."""
    with Scratch(edges.sparkSession) as scratch:
        edges = scratch.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        before = None
        for _ in range(max_rounds):
            last, edges = edges, scratch.written(_small_star(_large_star(edges)), "edges")
            scratch.drop(last)
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("components did not settle")
        roots = edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
        return written(edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots), "components")
