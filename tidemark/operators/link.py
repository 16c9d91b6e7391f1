"""Link values between entities: how often they follow or share events, relative to their own counts.

Counts are sparse: pairs that never meet have no row and the link 0. Rows are (kind, x1, x2, y1, y2,
weight); x2 and y2 are null unless that side is a segment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import Staging

from .ranks import ranked

KINDS = ("aa", "ss", "as", "rr", "ar", "rs")
PAIR = ["x1", "x2", "y1", "y2"]


def _pairs(df: DataFrame, kind: str, x1: Column, y1: Column, weight: Column, x2: Column | None = None, y2: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("kind"), x1.alias("x1"), (null if x2 is None else x2).alias("x2"), y1.alias("y1"), (null if y2 is None else y2).alias("y2"), weight.alias("weight"))


def _both_ways(counts: DataFrame, singles: DataFrame) -> DataFrame:
    """Of pair counts (x, y, n) and single counts (e, c): max(n(x,y)/c(x), n(y,x)/c(y)) for every pair that has either."""
    ratio = counts.join(singles, counts.x == singles.e).select("x", "y", (F.col("n") / F.col("c")).alias("v"))
    turned = ratio.select(F.col("y").alias("x"), F.col("x").alias("y"), "v")
    return ratio.unionByName(turned).groupBy("x", "y").agg(F.max("v").alias("v"))


def raw_links(kind: str, log: DataFrame, steps: DataFrame) -> DataFrame:
    """Links of one kind before they are normalised."""
    acts = log.groupBy(F.col("act").alias("e")).agg(F.count("*").alias("c"))
    ress = log.filter("res is not null").groupBy(F.col("res").alias("e")).agg(F.count("*").alias("c"))
    seg = F.struct(F.col("a_i").alias("a"), F.col("a_j").alias("b"))
    segs = steps.groupBy(seg.alias("e")).agg(F.count("*").alias("c"))
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    if kind == "aa":
        counts = steps.groupBy(F.col("a_i").alias("x"), F.col("a_j").alias("y")).agg(F.count("*").alias("n"))
        return _pairs(_both_ways(counts, acts), kind, x, y, v)
    if kind == "rr":
        counts = steps.filter("r_i is not null and r_j is not null").groupBy(F.col("r_i").alias("x"), F.col("r_j").alias("y")).agg(F.count("*").alias("n"))
        return _pairs(_both_ways(counts, ress), kind, x, y, v)
    if kind == "ss":
        # a middle event with what leads to it and what follows: counts of both, grouped by case and event, are joined
        into = steps.groupBy("case_id", F.col("pos_j").alias("pos"), seg.alias("x")).agg(F.count("*").alias("k"))
        out = steps.groupBy("case_id", F.col("pos_i").alias("pos"), seg.alias("y")).agg(F.count("*").alias("l"))
        counts = into.join(out, ["case_id", "pos"]).groupBy("x", "y").agg(F.sum(F.col("k") * F.col("l")).alias("n"))
        return _pairs(_both_ways(counts, segs), kind, F.col("x.a"), F.col("y.a"), v, F.col("x.b"), F.col("y.b"))
    if kind == "as":
        ends = segs.select("e", "c", F.explode(F.array_distinct(F.array("e.a", "e.b"))).alias("x"))
        counts = ends.join(acts.select(F.col("e").alias("x"), F.col("c").alias("d")), "x")
        return _pairs(counts, kind, x, F.col("e.a"), F.col("c") / F.col("d"), None, F.col("e.b"))
    if kind == "ar":
        counts = log.filter("res is not null").groupBy(F.col("act").alias("x"), F.col("res").alias("y")).agg(F.count("*").alias("n"))
        both = counts.join(acts.select(F.col("e").alias("x"), F.col("c").alias("cx")), "x").join(ress.select(F.col("e").alias("y"), F.col("c").alias("cy")), "y")
        return _pairs(both, kind, x, y, F.greatest(F.col("n") / F.col("cx"), F.col("n") / F.col("cy")))
    if kind == "rs":
        halves = steps.select(seg.alias("y"), F.explode(F.array("r_i", "r_j")).alias("x")).filter("x is not null")
        counts = halves.groupBy("x", "y").agg((F.count("*") / 2).alias("n"))
        both = counts.join(ress.select(F.col("e").alias("x"), F.col("c").alias("cx")), "x").join(segs.select(F.col("e").alias("y"), F.col("c").alias("cy")), "y")
        return _pairs(both, kind, x, F.col("y.a"), F.greatest(F.col("n") / F.col("cx"), F.col("n") / F.col("cy")), None, F.col("y.b"))
    raise ValueError(f"unknown kind of link {kind!r}; they are {', '.join(KINDS)}")


def links(log: DataFrame, steps: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Links of all kinds, each kind divided by its largest, rounded so that equal links are equal numbers.

    Raw links, few beside the events, are staged: they are read for their largest and again to be divided.
    """
    raw = Staging(log.sparkSession, "links").table(reduce(DataFrame.unionByName, [raw_links(k, log, steps) for k in kinds]), "raw")
    top = raw.groupBy("kind").agg(F.max("weight").alias("top"))
    return raw.join(F.broadcast(top), "kind").withColumn("weight", F.round(F.col("weight") / F.col("top"), 9)).drop("top")


def symmetric(link: DataFrame) -> DataFrame:
    """Each link from both sides; pairs of one kind already are."""
    turned = link.select("kind", F.col("y1").alias("x1"), F.col("y2").alias("x2"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), "weight")
    return link.unionByName(turned).distinct()


def spread(link: DataFrame) -> DataFrame:
    """Positive weights of a kind become evenly spaced: the i-th smallest of n distinct ones is i / n.

    Ranks are made over distinct weights, one row each, not over all pairs, and in ranges of them.
    """
    distinct = link.filter("weight > 0").select("kind", "weight").distinct()
    places = ranked(distinct, ["kind"], ["weight"])
    counts = places.groupBy("kind").agg(F.count("*").alias("n"))
    even = places.join(counts, "kind").select("kind", "weight", F.round((F.col("before") + 1) / F.col("n"), 9).alias("even"))
    return link.join(even, ["kind", "weight"], "left").select("kind", *PAIR, F.coalesce("even", F.lit(0.0)).alias("weight"))
