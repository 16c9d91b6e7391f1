"""Overlap of high-level events in place, time and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import Staging, not_broadcast

from .ranks import ranked


def spreads(hles: DataFrame) -> DataFrame:
    """First and last window of an event's start and end. A window pair starts in one and ends in the other;
    in a single window, exit, workload and handover start where their steps did, enter ends where they do."""
    pair, back = F.col("w1") < F.col("w2"), F.col("f_type").isin("exit", "workload", "handover")
    segment = F.col("comp_type") == "segment"
    start = lambda c: F.when(segment & ~pair & back, F.coalesce(c, "w1")).otherwise(F.col("w1"))
    end = lambda c: F.when(segment & ~pair & (F.col("f_type") == "enter"), F.coalesce(c, "w2")).otherwise(F.col("w2"))
    return hles.withColumns({"start_first": start("w_i_min"), "start_last": start("w_i_max"), "end_first": end("w_j_min"), "end_last": end("w_j_max")})


def as_rows(cases: DataFrame) -> DataFrame:
    """(hle_id, case_id), once each, of case sets or rows."""
    return cases.select("hle_id", F.explode("cases").alias("case_id")) if "cases" in cases.columns else cases.select("hle_id", "case_id")


def _sides(spread: DataFrame) -> tuple[DataFrame, DataFrame]:
    seg = spread.filter("comp_type = 'segment'")
    a = seg.select(F.col("hle_id").alias("src"), F.col("e2").alias("at"), "end_first", "end_last")
    return a, seg.select(F.col("hle_id").alias("dst"), F.col("e1").alias("at"), "start_first", "start_last")


def _meet() -> Column:
    """Whether the windows of the first one's end and of the second one's start contain each other."""
    inside = (F.col("end_first") >= F.col("start_first")) & (F.col("end_last") <= F.col("start_last"))
    around = (F.col("start_first") >= F.col("end_first")) & (F.col("start_last") <= F.col("end_last"))
    return (inside | around) & (F.col("src") != F.col("dst"))


def near(spread: DataFrame) -> DataFrame:
    """(src, dst): segments where the second begins at the activity at which the first ends, whose windows of end and start
    contain each other, by shared activity and window: where one range contains another, the inner one's first window
    lies in the outer."""
    a, b = _sides(spread)
    each = lambda first, last: F.explode(F.sequence(F.col(first), F.col(last)))
    within = a.withColumn("w", F.col("end_first")).join(b.withColumn("w", each("start_first", "start_last")), ["at", "w"])
    beyond = a.withColumn("w", each("end_first", "end_last")).join(b.withColumn("w", F.col("start_first")), ["at", "w"])
    return within.filter(_meet()).select("src", "dst").unionByName(beyond.filter(_meet()).select("src", "dst")).distinct()


def prefixes(rows: DataFrame, least: float, stage: Staging) -> DataFrame:
    """(hle_id, size, case_id): the cases of each set of which two sets that overlap by ``least`` share one at least: all but the
    ``least`` part, rarest cases first. Places within sets come from ranges, so a set may have any number of cases."""
    common = rows.groupBy("case_id").agg(F.count("*").alias("_often"))
    sized = rows.groupBy("hle_id").agg(F.count("*").alias("size"))
    placed = ranked(not_broadcast(rows).join(common, "case_id"), ["hle_id"], ["_often", "case_id"], stage=stage).join(sized, "hle_id")
    need = F.ceil(F.col("size") * (least - _SLACK))
    return placed.filter(F.col("before") <= F.col("size") - need).select("hle_id", "size", "case_id")


#: Overlaps are rounded to 9 places before they are compared.
_SLACK = 1e-9


def arcs(spread: DataFrame, cases: DataFrame, least: float) -> DataFrame:
    """(src, dst, overlap): pairs as in near() whose cases overlap by ``least``; cases are sets or rows (hle_id, case_id).

    A set-similarity join: pairs are looked for by the shared activity and a shared case among their sets' rarest
    ones, of sizes that allow the overlap; then all shared cases of these pairs are counted. Without a least overlap,
    pairs come from windows, as pairs that share nothing count too.
    """
    stage = Staging(spread.sparkSession, "similar")
    rows = stage.table(as_rows(cases), "rows")
    sized = rows.groupBy("hle_id").agg(F.count("*").alias("size"))
    if least > 0:
        rare = stage.table(prefixes(rows, least, Staging(spread.sparkSession, "prefixes")), "rare")
        a, b = _sides(spread)
        left = a.join(rare.select(F.col("hle_id").alias("src"), F.col("size").alias("n1"), "case_id"), "src")
        right = b.join(rare.select(F.col("hle_id").alias("dst"), F.col("size").alias("n2"), "case_id"), "dst")
        fit = (F.least("n1", "n2") >= F.greatest("n1", "n2") * (least - _SLACK)) & _meet()
        pairs = left.join(right, ["at", "case_id"]).filter(fit).select("src", "dst", "n1", "n2").distinct()
    else:
        of = lambda name, n: sized.select(F.col("hle_id").alias(name), F.col("size").alias(n))
        zero = {n: F.coalesce(n, F.lit(0)) for n in ("n1", "n2")}
        pairs = near(spread).join(of("src", "n1"), "src", "left").join(of("dst", "n2"), "dst", "left").withColumns(zero)
    pairs = stage.table(pairs, "pairs")
    # the smaller set's cases are looked up in the larger one
    turned = F.col("n1") <= F.col("n2")
    lookup = pairs.select("src", "dst", F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("hle_id"), F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("other"))
    shared = lookup.join(rows, "hle_id").join(not_broadcast(rows.select(F.col("hle_id").alias("other"), "case_id")), ["other", "case_id"]).groupBy("src", "dst").agg(F.count("*").alias("both"))
    union = F.nullif(F.col("n1") + F.col("n2") - F.col("both"), F.lit(0))
    found = pairs.join(shared, ["src", "dst"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return found.withColumn("overlap", F.round(F.coalesce(F.col("both") / union, F.lit(0.0)), 9)).filter(F.col("overlap") >= least).select("src", "dst", "overlap")


def windows_overlap(a_first: str, a_last: str, b_first: str, b_last: str):
    """Whether two ranges of windows meet at all: the weaker form of time overlap."""
    return (F.col(a_first) <= F.col(b_last)) & (F.col(b_first) <= F.col(a_last))
