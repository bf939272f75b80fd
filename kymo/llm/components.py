"""Connected components by distributed union-find: alternating large-star and small-star rounds over an edge table.

A round is joins and minima over the edges; nothing of the graph reaches the driver but a count and a checksum, and each
round's edges are a table in the shared folder. A star's centre with very many leaves is one row on the side of the
minima, so adaptive execution can split its leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import written


def _toward_minimum(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b by whatever order the column has; loops and nulls go."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root is the smallest node of the component.

    Repeated edges, loops and edges with a null change nothing; no edges give no rows.
    """
    now = written(_toward_minimum(edges), "edges")
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not sign["n"] or sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
        now = written(_small_star(_large_star(now)), "edges")
