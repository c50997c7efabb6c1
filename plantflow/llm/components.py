"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, written


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node reachable.

    Nodes are of one orderable type. Loops, repeated edges and both directions are fine; an edge with
    a null end is ignored; no edges give no rows. Each round is written to the shared folder, and the
    rounds end when all edges lead to a node that leads nowhere, after about log(n) of them.
    """
    now = written(_directed(edges.where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    while not now.select(F.col("b").alias("a")).distinct().join(now.select("a").distinct(), "a", "left_semi").isEmpty():
        wide = written(_directed(_large_star(now)), "edges")
        forget(now)
        now = written(_directed(_small_star(wide)), "edges")
        forget(wide)
    ends = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), "b").distinct())
    labels = written(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")), "labels")
    forget(now)
    return labels
