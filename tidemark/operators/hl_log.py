"""The high-level log: its cases are cascades, its activities features of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import ENTITY
from .windows import Frame


def label(only_component: bool = False) -> Column:
    """feature-class-entity, or the entity alone; a segment is (a,b)."""
    entity = F.when(F.col("comp_type") == "segment", F.concat(F.lit("("), "e1", F.lit(","), "e2", F.lit(")"))).otherwise(F.col("e1"))
    return entity if only_component else F.concat_ws("-", "f_type", "class", entity)


def _chosen(hles: DataFrame, cascade: DataFrame, hlas: DataFrame) -> DataFrame:
    on = [F.col(f"h.{k}").eqNullSafe(F.col(f"a.{k}")) for k in [*ENTITY, "class"]]
    kept = hles.filter("w1 = w2").alias("h").join(hlas.alias("a"), on, "left_semi")
    return kept.join(cascade, "hle_id")


def partial_order_log(hles: DataFrame, cascade: DataFrame, hlas: DataFrame, f: Frame, only_component: bool = False) -> DataFrame:
    """Events at the left border of their window: case, activity, left_s, value, component."""
    return _chosen(hles, cascade, hlas).select(F.col("cascade").alias("case"), label(only_component).alias("activity"), f.left(F.col("w1")).alias("left_s"), "value", F.col("comp_type").alias("component"))


def flat_log(hles: DataFrame, cascade: DataFrame, hlas: DataFrame, f: Frame, only_component: bool = False, compat: str = "fixed") -> DataFrame:
    """Events spread evenly over their window in the order of their labels: the i-th of n is at i / n of it.

    The reference spreads and labels them in two different orders, so that its labels sit on other events'
    cases and values; compat='reference' does so, with the ids' order as the second one.
    """
    rows = _chosen(hles, cascade, hlas).withColumn("activity", label(only_component))
    here = Window.partitionBy("w1")
    by_label, by_id = here.orderBy("activity", "hle_id"), here.orderBy("hle_id")
    n = F.count("*").over(here)
    if compat == "fixed":
        placed = rows.withColumn("i", F.row_number().over(by_label) - 1).withColumn("n", n)
    else:
        labels = rows.select("w1", "activity", F.row_number().over(by_label).alias("i"))
        placed = rows.drop("activity").withColumn("i", F.row_number().over(by_id)).withColumn("n", n).join(labels, ["w1", "i"]).withColumn("i", F.col("i") - 1)
    return placed.select(F.col("cascade").alias("case"), "activity", (f.left(F.col("w1")) + F.col("i") / F.col("n") * F.lit(f.size)).alias("at_s"), "value", F.col("comp_type").alias("component"))


def as_log(table: DataFrame, time: str) -> DataFrame:
    """A high-level table as an event log, for write_xes: values and components are further attributes."""
    place = Window.partitionBy("case_id").orderBy("us", "act")
    out = table.select(F.col("case").alias("case_id"), F.col("activity").alias("act"), F.round(F.col(time) * 1_000_000).cast("long").alias("us"), F.col("value").cast("string").alias("value"), F.col("component").alias("entity"))
    return out.withColumn("pos", (F.row_number().over(place) - 1).cast("long"))
