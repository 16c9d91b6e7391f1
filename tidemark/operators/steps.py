"""Directly-follows steps, components, and filters of cases and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import percentiles


def _case():
    return Window.partitionBy("case_id").orderBy("pos")


def total_order(log: DataFrame) -> DataFrame:
    """Steps between consecutive positions of a case."""
    after = F.lead(F.struct("pos", "act", "res", "us")).over(_case())
    return log.withColumn("j", after).filter("j is not null").select("case_id", F.col("pos").alias("pos_i"), F.col("j.pos").alias("pos_j"), F.col("act").alias("a_i"), F.col("j.act").alias("a_j"), F.col("res").alias("r_i"), F.col("j.res").alias("r_j"), F.col("us").alias("us_i"), F.col("j.us").alias("us_j"))


def tie_classes(log: DataFrame) -> DataFrame:
    """Adds ``tie``: consecutive events of a case at one time share a class, numbered in order."""
    changed = F.coalesce((F.col("us") != F.lag("us").over(_case())).cast("int"), F.lit(0))
    return log.withColumn("_new", changed).withColumn("tie", F.sum("_new").over(_case())).drop("_new")


def partial_order(log: DataFrame) -> DataFrame:
    """Steps from every event of a tie class to every event of the next one; without ties, the total order's.

    The next class is gathered once and attached to each event by a window, so events are shuffled by
    case alone and no class is joined with itself.
    """
    tied = tie_classes(log)
    classes = tied.groupBy("case_id", "tie").agg(F.collect_list(F.struct("pos", "act", "res", "us")).alias("es"))
    after = classes.withColumn("next", F.lead("es").over(Window.partitionBy("case_id").orderBy("tie"))).filter("next is not null")
    pairs = after.select("case_id", F.explode("es").alias("i"), "next").select("case_id", "i", F.explode("next").alias("j"))
    cols = [F.col(f"{e}.{c}").alias(f"{n}_{e}") for c, n in (("pos", "pos"), ("act", "a"), ("res", "r"), ("us", "us")) for e in ("i", "j")]
    return pairs.select("case_id", *cols)


def directly_follows(log: DataFrame, method: str = "df", ties: bool = True) -> DataFrame:
    """Steps of a log. ``ties=False`` is the short way for logs that are known to have none."""
    if method != "df":
        raise ValueError(f"unknown step method {method!r}; there is 'df'")
    return partial_order(log) if ties else total_order(log)


def triggers(steps: DataFrame) -> DataFrame:
    """For each event that has any: the positions that follow it, in order."""
    return steps.groupBy("case_id", F.col("pos_i").alias("pos")).agg(F.sort_array(F.collect_set("pos_j")).alias("triggers"))


def releases(steps: DataFrame) -> DataFrame:
    """For each event that has any: the positions that it follows, in order."""
    return steps.groupBy("case_id", F.col("pos_j").alias("pos")).agg(F.sort_array(F.collect_set("pos_i")).alias("releases"))


def finals(log: DataFrame, steps: DataFrame) -> DataFrame:
    """Events that nothing follows."""
    return log.join(steps.select("case_id", F.col("pos_i").alias("pos")), ["case_id", "pos"], "left_anti")


def components(log: DataFrame, steps: DataFrame, resources: bool = True) -> DataFrame:
    """Distinct entities (comp_type, e1, e2). The type is part of the key, so that equal names of different types stay apart."""
    null = F.lit(None).cast("string")
    kind = lambda df, t, a, b: df.select(F.lit(t).alias("comp_type"), a.alias("e1"), b.alias("e2"))
    out = kind(log, "activity", F.col("act"), null).unionByName(kind(steps, "segment", F.col("a_i"), F.col("a_j")))
    if resources:
        out = out.unionByName(kind(log.filter("res is not null"), "resource", F.col("res"), null))
    return out.distinct()


def segment_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("a_i", "a_j").agg(F.count("*").alias("n"))


def frequent_segments(log: DataFrame, share: float, compat: str = "fixed") -> DataFrame:
    """Segments whose count reaches the percentile ``share`` of all counts. The reference's way counts plain
    consecutive pairs even where times tie. The percentile is one number, read on the driver."""
    counts = segment_counts(total_order(log) if compat == "reference" else partial_order(log))
    least = percentiles(counts, [], "n", {"least": share}).first()
    return counts.filter(F.col("n") >= F.lit(least[0] if least and least[0] is not None else 0.0))


def surviving_steps(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """Steps of the given segments: a semi-join on the segment."""
    return steps.join(segments.select("a_i", "a_j"), ["a_i", "a_j"], "left_semi")


def select_activities(steps: DataFrame, activities: list[str]) -> DataFrame:
    """Steps with both ends among the activities."""
    return steps.filter(F.col("a_i").isin(activities) & F.col("a_j").isin(activities))


def select_resources(log: DataFrame, resources: list[str]) -> DataFrame:
    return log.filter(F.col("res").isin(resources))


def cases_with(log: DataFrame, activities: list[str]) -> DataFrame:
    """All events of the cases that have any of the activities."""
    return log.join(log.filter(F.col("act").isin(activities)).select("case_id"), "case_id", "left_semi")


def relabel_lifecycle(log: DataFrame, prefix: str = "W", lifecycle: str = "lifecycle") -> DataFrame:
    """Activities that begin with the prefix get their lifecycle state behind a bar."""
    return log.withColumn("act", F.when(F.col("act").startswith(prefix), F.concat_ws("|", "act", lifecycle)).otherwise(F.col("act")))


def resources_except(log: DataFrame, left_out: list[str]) -> DataFrame:
    return log.filter(F.col("res").isNotNull() & ~F.col("res").isin(left_out)).select("res").distinct()


def control_flow(log: DataFrame) -> DataFrame:
    """Each case's activities in order."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "act")))
    return log.groupBy("case_id").agg(F.transform(ordered, lambda x: x["act"]).alias("flow"))
