"""Whole analyses: a high-level log of cascades, and paths with their cases and outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import casebits, cascade, detect, features, forest, hl_log, link, overlap, participation, paths, stats, steps, windows
from tidemark.storage import Staging


@dataclass(frozen=True)
class Prepared:
    """A log with its steps by window, staged: what all features read."""

    log: DataFrame
    steps: DataFrame
    frame: windows.Frame
    scope: features.Scope = features.ALL


def prepare(log: DataFrame, width: str | int = "days", ties: bool = True, compat: str = "fixed", scope: features.Scope = features.ALL) -> Prepared:
    stage = Staging(log.sparkSession, "log")
    f = windows.frame(log, width, compat)
    events = stage.table(windows.with_windows(log, f), "events")
    pairs = steps.directly_follows(log, ties=ties)
    return Prepared(events, stage.table(windows.steps_with_windows(pairs, f), "steps"), f, scope)


def high_level_events(p: Prepared, chosen: tuple[str, ...], share: float = 0.9, by: str = "type", traffic: tuple[str, ...] = ("High",), compat: str = "fixed") -> tuple[DataFrame, DataFrame]:
    """Values and the high-level events among them, staged. With 'Low' asked for, zeros below a threshold count too."""
    stage = Staging(p.log.sparkSession, "hle")
    vals = stage.table(features.values(chosen, p.log, p.steps, p.frame, compat, p.scope), "values")
    limits = stage.table(detect.thresholds(vals, share, by), "limits")
    found = detect.detect(vals, limits, traffic, by)
    if "Low" in traffic and by == "type":
        found = found.unionByName(detect.low_zeros(vals, limits, p.frame.borders(p.log.sparkSession)), allowMissingColumns=True)
    return vals, stage.table(found, "hles")


def cascade_log(log: DataFrame, width: str | int = "days", chosen: tuple[str, ...] = features.LOG_FEATURES, share: float = 0.9, by: str = "type", traffic: tuple[str, ...] = ("High",), least_link: float = 0.5, frequency: float = 0, flat: bool = True, only_component: bool = False, ties: bool = True, compat: str = "fixed", activities: tuple[str, ...] | None = None, resources: tuple[str, ...] | None = None) -> DataFrame:
    """The high-level log: events, steps, features, high-level events, links, cascades, table. ``activities`` and
    ``resources`` choose whose features are looked at (no resources: no features of resources)."""
    p = prepare(log, width, ties, compat, features.Scope(activities, resources))
    _, hles = high_level_events(p, chosen, share, by, traffic, compat)
    linked = link.spread(link.links(p.log, p.steps))
    cascades = cascade.cascades(hles, linked, least_link)
    hlas = detect.filter_hla(hles, frequency, compat)
    make = hl_log.flat_log if flat else hl_log.partial_order_log
    more = {"compat": compat} if flat else {}
    return make(hles, cascades, hlas, p.frame, only_component, **more)


@dataclass(frozen=True)
class Paths:
    """High-level events, their cases as rows, arcs, paths of events and of activities; cases and paths as listings too."""

    hles: DataFrame
    rows: DataFrame
    arcs: DataFrame
    found: forest.Found
    activities: participation.Activities

    @property
    def cases(self) -> DataFrame:
        return self.rows.groupBy("hle_id").agg(F.sort_array(F.collect_list("case_id")).alias("cases"))

    @property
    def paths(self) -> DataFrame:
        return self.found.listing()

    @property
    def hla(self) -> DataFrame:
        return self.activities.listing()


def path_analysis(log: DataFrame, width: str | int = "days", chosen: tuple[str, ...] = features.PATH_FEATURES, share: float = 0.9, by: str = "type", traffic: tuple[str, ...] = ("High",), least_overlap: float = 0.5, least_path_overlap: float = 0.5, path_frequency: int = 0, segment_share: float = 0.8, only_maximal: bool = True, ties: bool = True, compat: str = "fixed", activities: tuple[str, ...] | None = None, resources: tuple[str, ...] | None = None) -> Paths:
    """High-level events of frequent segments, their overlaps, the paths along them, and their activities. ``activities``
    and ``resources`` choose whose features are looked at; ``segment_share`` restricts features of segments alone."""
    kept = steps.frequent_segments(log, segment_share, compat) if segment_share > 0 else None
    p = prepare(log, width, ties, compat, features.Scope(activities, resources, kept))
    stage = Staging(log.sparkSession, "analysis")
    _, hles = high_level_events(p, chosen, share, by, traffic, compat)
    cases = stage.table(detect.case_rows(hles, features.all_instances(chosen, p.log, p.steps, p.frame, compat, p.scope)), "cases")
    arcs = stage.table(overlap.arcs(overlap.spreads(hles), cases, least_overlap), "arcs")
    usable = paths.prune_arcs(arcs, least_path_overlap) if least_path_overlap > least_overlap else arcs
    numbers = stage.table(casebits.numbered(p.log), "numbers")
    found = forest.grow(hles.select("hle_id"), usable, cases, least_path_overlap, only_maximal, numbers=numbers)
    return Paths(hles, cases, arcs, found, participation.activities_of(found, hles).frequent(path_frequency))


def outcome_study(log: DataFrame, amount: str | None = None, complete: tuple[str, ...] = ("A_Pending", "A_Cancelled", "A_Denied"), success: str = "A_Pending", **settings) -> dict[str, DataFrame]:
    """The study's preset: cases that ended, activities with lifecycle, paths and their significance by outcome,
    throughput time and, if there is one, amount. Settings go to path_analysis()."""
    preset = {"share": 0.9, "least_overlap": 0.5, "least_path_overlap": 0.5, "path_frequency": 10, "segment_share": 0.9, "by": "entity"}
    kept = steps.cases_with(log, list(complete))
    if "lifecycle" in kept.columns:
        kept = steps.relabel_lifecycle(kept)
    found = path_analysis(kept, **(preset | settings))
    table = participation.statistics(found.activities, kept)
    out = {"statistics": table.listing(), "success": stats.result_table(table, stats.outcome_partition(kept, success), 2, ["succ", "notsucc"]), "throughput": stats.result_table(table, stats.throughput_partition(kept), 3, ["under10", "10to30", "over30"])}
    if amount:
        out["amount"] = stats.result_table(table, stats.amount_partition(kept, amount), 2, ["under", "over"])
    return out


def hle_table(hles: DataFrame) -> DataFrame:
    """Rows for a CSV file: id, type, segment, activity, value, window."""
    entity = F.concat_ws(",", "e1", "e2")
    return hles.select(F.col("hle_id").alias("hle-id"), F.col("f_type").alias("type"), entity.alias("segment"), F.concat_ws(":", F.col("f_type"), entity).alias("activity"), "value", F.when(F.col("w1") == F.col("w2"), F.col("w1").cast("string")).otherwise(F.concat_ws(",", F.col("w1").cast("string"), F.col("w2").cast("string"))).alias("window"))
