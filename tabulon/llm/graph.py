"""Connected components of an edge table, by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import discard, written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star pass over edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return small.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge, to a node without any of its own."""
    degree = edges.groupBy("a").agg(F.count("*").alias("n"))
    below = edges.select(F.col("b").alias("a")).distinct()
    return degree.join(below.withColumn("root", F.lit(True)), "a", "left").where("n > 1 or root").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge, with root the least node that it reaches.

    ``edges`` has columns a and b of one orderable type. Self-loops, repeats and either direction are
    allowed; rows with a null are no edges. Each round is written to the shared folder, so that the
    plan doesn't grow and a lost executor costs one round; a node of many edges is never gathered,
    as only minima are taken over its edges. Rounds end when every edge leads from a node of its own to a root.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        old, now = now, written(_stars(now), "edges")
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
