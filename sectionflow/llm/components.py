"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionflow.session import materialize


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Columns node, root for every node of ``edges(a, b)``; root is the smallest reachable node.

    Alternates two steps on edges that point to a smaller node until nothing
    changes: all larger neighbours of a node move to its smallest neighbour,
    then all smaller ones do.  Each step is a minimum per node, combined before
    the shuffle, and one join that the adaptive planner splits at nodes with
    very many edges.  Every round's edges are written to shared storage.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, label)
    seen = _mark(edges)
    while seen[0]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low.select("u", "m")).distinct(), label)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them that tells whether a round changed any."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
