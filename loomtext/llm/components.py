"""Connected components of a graph given as an edge table, by alternating star contractions.

Each round links every neighbour of a node to the smallest one (first the larger neighbours, then the smaller ones).
Rounds end when the edges no longer change: then each node hangs on the smallest of its component. Hubs are handled
by a minimum with map-side partial aggregation and by a join, so no neighbourhood is gathered in one place. Every
round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import Spilled


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of the component."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now, seen = Spilled(pairs, "edges"), None
    while True:
        state = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        large = Spilled(_large_star(now.df).distinct(), "stars")
        new = Spilled(_small_star(large.df).distinct(), "edges")
        now.drop()
        large.drop()
        now = new
    roots = now.df.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
