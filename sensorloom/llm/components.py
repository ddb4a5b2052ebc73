"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.sources.scratch import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges (a, b)``; the component is its smallest node.

    Alternates two star contractions: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows. The number of edges never grows and the rounds grow with the logarithm of the
    longest path. Each round is a written table; only a count and a checksum reach the driver. A hub's edges
    meet its minimum in a plain equi-join, which adaptive execution can split.
    """
    current = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        state = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)).alias("check")
        ).first()
        if state == seen:
            break
        seen = state
        current = materialize(_contract(current), "edges")
    labels = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return labels.unionByName(roots)


def _contract(edges: DataFrame) -> DataFrame:
    """One large star and one small star. Edges go from the larger node ``a`` to the smaller ``b``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    large = (
        both.where(F.col("b") > F.col("a"))
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionByName(edges.groupBy("a").agg(F.min("b").alias("b")))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    large = materialize(large, "edges")
    least = large.groupBy("a").agg(F.min("b").alias("least"))
    moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    kept = least.select("a", F.col("least").alias("b"))
    return moved.unionByName(kept).where(F.col("a") != F.col("b")).distinct()
