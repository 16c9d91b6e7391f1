"""Cascades: high-level events of neighbouring windows, linked strongly enough, and their components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import Staging

from .components import connected


def _letter(kind: Column) -> Column:
    return F.substring(kind, 1, 1)


def edges(hles: DataFrame, link: DataFrame, least: float) -> DataFrame:
    """(u, v, weight): events of windows w and w + 1; of one entity with weight 1, else by the entities' link.

    Events of window pairs take no part. ``link`` holds each kind once, in the order a, r, s of its sides;
    windows' events are paired by an equal number, and only pairs with a link of at least ``least`` or one
    entity are formed: the links are joined by entity before the second window. ``least`` is above 0: with 0, all
    events of neighbouring windows are linked, which window_edges() says with fewer edges.
    """
    if least <= 0:
        raise ValueError("least is above 0; window_edges() links all events of neighbouring windows")
    single = hles.filter("w1 = w2").select("hle_id", F.col("w1").alias("w"), "comp_type", "e1", F.coalesce("e2", F.lit("")).alias("e2"))
    null_safe = link.filter(F.col("weight") >= least).select("kind", "x1", F.coalesce("x2", F.lit("")).alias("x2"), "y1", F.coalesce("y2", F.lit("")).alias("y2"), "weight")
    turned = null_safe.filter("substring(kind, 1, 1) <> substring(kind, 2, 1)").select(F.reverse("kind").alias("kind"), F.col("y1").alias("x1"), F.col("y2").alias("x2"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), "weight")
    entity = single.select("comp_type", "e1", "e2").distinct()
    same = entity.select(F.concat(_letter(F.col("comp_type")), _letter(F.col("comp_type"))).alias("kind"), F.col("e1").alias("x1"), F.col("e2").alias("x2"), F.col("e1").alias("y1"), F.col("e2").alias("y2"), F.lit(1.0).alias("weight"))
    all_links = null_safe.unionByName(turned).unionByName(same).groupBy("kind", "x1", "x2", "y1", "y2").agg(F.max("weight").alias("weight"))
    all_links = all_links.withColumn("weight", F.when((F.substring("kind", 1, 1) == F.substring("kind", 2, 1)) & (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2")), F.lit(1.0)).otherwise(F.col("weight")))
    u = single.select(F.col("hle_id").alias("u"), F.col("w"), _letter(F.col("comp_type")).alias("t1"), F.col("e1").alias("x1"), F.col("e2").alias("x2"))
    half = u.join(all_links.withColumns({"t1": F.substring("kind", 1, 1), "t2": F.substring("kind", 2, 1)}), ["t1", "x1", "x2"])
    v = single.select(F.col("hle_id").alias("v"), (F.col("w") - 1).alias("w"), _letter(F.col("comp_type")).alias("t2"), F.col("e1").alias("y1"), F.col("e2").alias("y2"))
    return half.join(v, ["w", "t2", "y1", "y2"]).filter(F.col("weight") >= least).select("u", "v", "weight")


def window_edges(hles: DataFrame) -> DataFrame:
    """(u, v) whose components are those of all pairs of events of neighbouring windows, linked or not (a least link of 0): a star
    around the first event of a window for the windows beside it. One edge an event and neighbour instead of all pairs."""
    single = hles.filter("w1 = w2").select("hle_id", F.col("w1").alias("w"))
    first = single.groupBy("w").agg(F.min("hle_id").alias("v"))
    beside = [first.select((F.col("w") + d).alias("w"), "v") for d in (-1, 1)]
    return single.join(beside[0].unionByName(beside[1]), "w").select(F.col("hle_id").alias("u"), "v")


def cascades(hles: DataFrame, link: DataFrame, least: float) -> DataFrame:
    """hle_id and its cascade, named by the cascade's first event; events without an edge are cascades of their own."""
    stage = Staging(hles.sparkSession, "cascade")
    linked = edges(hles, link, least).select("u", "v") if least > 0 else window_edges(hles)
    found = connected(stage, linked, "cascades")
    single = hles.filter("w1 = w2").select("hle_id")
    return single.join(found.withColumnRenamed("node", "hle_id"), "hle_id", "left").select("hle_id", F.coalesce("component", "hle_id").alias("cascade"))


def components_of(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected components of any directed graph (src, dst) over nodes (hle_id)."""
    stage = Staging(nodes.sparkSession, "components")
    found = connected(stage, arcs.select(F.col("src").alias("u"), F.col("dst").alias("v")), "graph")
    return nodes.select("hle_id").join(found.withColumnRenamed("node", "hle_id"), "hle_id", "left").select("hle_id", F.coalesce("component", "hle_id").alias("component"))
