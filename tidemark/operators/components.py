"""Connected components by alternating large-star and small-star over tables of edges.

Each round rewires edges towards smaller neighbours until they are stars around each component's
smallest node. Tables of a round are written to the shared folder, in as many parts as their rows ask
for; neighbours' minima are written before they are joined, so both sides of a join are plain shuffles,
or broadcasts of a size that Spark knows, which adaptive execution splits where a hub has many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import Staging

#: Edges for each part of a staged table.
PART_EDGES, LEAST_PARTS = 50_000, 4


def connected(stage: Staging, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node with an edge to another one; the component is its smallest node."""
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, turn = stage.table(ends, f"{name}-0"), 0
    parts = max(LEAST_PARTS, now.count() // PART_EDGES)
    while not _are_stars(now, parts):
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts), f"{name}-least")
        large = stage.table(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), f"{name}-large")
        low = stage.table(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), f"{name}-low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        now = stage.table(small.distinct().coalesce(parts), f"{name}-{turn}")
        stage.drop(f"{name}-{turn - 1}")
    for label in ("least", "large", "low"):
        stage.drop(f"{name}-{label}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame, parts: int) -> bool:
    """Whether every node has one edge down, or is the centre of others and has none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    odd = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)")
    return odd.coalesce(parts).count() == 0
