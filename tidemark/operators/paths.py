"""Paths of overlapping high-level events that share cases, and what they say about the cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sets import contains_joined, contains_run, project

from .forest import grow
from .overlap import as_rows


def hle_paths(nodes: DataFrame, arcs: DataFrame, cases: DataFrame, least: float, only_maximal: bool = True, longest: int | None = None) -> DataFrame:
    """(path, cases), a listing of what forest.grow() finds: from every node, each path that no neighbour extends."""
    return grow(nodes, arcs, cases, least, only_maximal, longest).listing()


def prune_arcs(arcs: DataFrame, least: float) -> DataFrame:
    """Arcs whose own overlap is below what paths need can extend none."""
    return arcs.filter(F.col("overlap") >= least)


#: Characters of a joined run by which cases are found.
_KEY_CHARS = 16


def activities(path: Column) -> Column:
    return project(path)


def case_pool(paths: DataFrame, flows: DataFrame, compat: str = "fixed") -> DataFrame:
    """Cases whose control flow holds the path's activities in a row: (hla_path, relevant).

    Cases and paths meet by the first two activities, so that only cases that can match are compared: a join by equal keys.
    """
    wanted = paths.select("hla_path", activities(F.col("hla_path")).alias("run"))
    if compat == "reference":
        # names may match inside of names there: cases and paths meet by the first characters of the joined run,
        # which stand somewhere in the joined flow
        wanted = wanted.withColumn("text", F.array_join("run", "#"))
        most = min(_KEY_CHARS, wanted.agg(F.min(F.char_length("text"))).first()[0] or 0)
        if most == 0:
            return wanted.select("hla_path", F.array().cast(f"array<{dict(flows.dtypes)['case_id']}>").alias("relevant")).limit(0)
        joined = flows.withColumn("_text", F.array_join("flow", "#"))
        places = F.sequence(F.lit(1), F.greatest(F.char_length("_text") - most + 1, F.lit(1)))
        keys = F.array_distinct(F.transform(places, lambda i: F.substring("_text", i, F.lit(most))))
        hits = joined.withColumn("first", F.explode(keys)).join(wanted.withColumn("first", F.substring("text", 1, most)), "first").filter(contains_joined(F.col("flow"), F.col("run")))
    else:
        wanted = wanted.withColumn("first", F.struct(F.get("run", F.lit(0)).alias("a"), F.get("run", F.lit(1)).alias("b")))
        pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("flow") - 2, F.lit(0))), lambda i: F.struct(F.get("flow", i).alias("a"), F.get("flow", i + 1).alias("b"))))
        hits = flows.withColumn("first", F.explode(pairs)).join(wanted, "first").filter(contains_run(F.col("flow"), F.col("run")))
    return hits.groupBy("hla_path").agg(F.sort_array(F.collect_set("case_id")).alias("relevant"))


def maximal(paths: DataFrame) -> DataFrame:
    """Paths that are no proper prefix of another one: each path's prefixes are taken out by an anti-join."""
    prefixes = paths.filter("size(path) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))).alias("path")).distinct()
    return paths.join(prefixes, "path", "left_anti")


def hles_by_case(cases: DataFrame) -> DataFrame:
    """The inverse of case sets or rows: each case's high-level events."""
    return as_rows(cases).groupBy("case_id").agg(F.sort_array(F.collect_set("hle_id")).alias("hles"))


__all__ = ["activities", "case_pool", "hle_paths", "hles_by_case", "maximal", "prune_arcs"]
