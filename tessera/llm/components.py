"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.storage import discard, materialize


def _round(now: DataFrame) -> DataFrame:
    # Large star: every larger neighbour of a node is linked with the node's smallest neighbour, or the node itself.
    both = now.union(now.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    # Small star: a node's smaller neighbours, and the node itself, are linked with the smallest of them.
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return small.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (columns a, b; order and repeats don't matter). A component's name is its
    smallest node. Each round joins the nodes with their smallest neighbour, which needs a number of rounds that grows with
    the logarithm of the largest component; what a round has made is written to the shared folder, and what it was made from deleted.
    Raises RuntimeError if the components aren't complete after ``most_rounds``."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        mark = Observation()
        new = materialize(_round(now).observe(mark, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
        discard(now)
        now = new
        if mark.get == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = mark.get
    raise RuntimeError(f"components are not complete after {most_rounds} rounds")
