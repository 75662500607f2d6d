"""Distributed connected components by small stars and pointer jumps, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsieve.llm.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with v < u, both long. Gives (node, root) for every u, root the smallest node it is linked to.

    A round turns each node's several smaller neighbours into neighbours of the smallest of them, then moves each
    node to its neighbour's smallest neighbour. It ends when every node has one neighbour and that one has none.
    The window over a node's smaller neighbours is as large as their number: callers give edges to the least node
    of each group that was compared together, so it is bounded by the groups a node is in.
    """
    edges = materialize(edges.select("u", "v").filter("u > v").distinct())
    while True:
        least = F.min("v").over(Window.partitionBy("u"))
        stars = edges.select("u", "v", least.alias("m"))
        stars = stars.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        stars = materialize(stars)
        parents = materialize(stars.groupBy("u").agg(F.min("v").alias("p"), F.count(F.lit(1)).alias("c")))
        several = parents.filter("c > 1").limit(1).count()
        up = parents.select(F.col("u").alias("v"), "p")
        jumped = materialize(stars.join(up, "v", "left").select("u", F.coalesce("p", "v").alias("v"), F.col("p").isNotNull().alias("moved")))
        moved = jumped.filter("moved").limit(1).count()
        if not several and not moved:
            return jumped.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = jumped.select("u", "v").distinct()
