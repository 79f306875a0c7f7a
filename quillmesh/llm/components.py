"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.filter("v > u")
        .join(least.select("u", F.least("u", "m").alias("m")), "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Edges ``(u, v)`` of longs to ``(node, label)``, where the label is the smallest node reachable.

    Only nodes that have an edge to another node are returned; loops and repeated edges are allowed.
    Each round is one table in the shared folder; neighbour lists are never collected, only their
    minimum, so a node with very many neighbours is a sum of partial minima and a (splittable) join.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = materialise(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name
    )
    seen = state(now)
    while seen[0]:
        new = materialise(_small_star(_large_star(now)).filter("u <> v").distinct(), name)
        discard(now)
        now, before = new, seen
        seen = state(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
