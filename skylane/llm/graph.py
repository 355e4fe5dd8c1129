"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.llm.common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``; root is the smallest node of its component.

    Each round links every larger neighbour of a node to the smallest one
    (large star), then every smaller neighbour (small star), until each node
    but the roots hangs on a root. Rounds grow with the logarithm of the
    longest chain; rounds are staged tables, so nothing is kept by executors,
    and a node with a third of all links is only ever partially aggregated
    and joined, never gathered.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u > v")
        e = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        open_nodes = e.select(F.col("v").alias("u")).distinct().join(e.select("u"), "u", "left_semi")
        forks = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if open_nodes.unionByName(forks).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
