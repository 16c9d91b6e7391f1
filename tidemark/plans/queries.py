"""Registered queries: each operator on the table ``events``, and the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.sets import contains_run, jaccard
from tidemark.functions.units import unit_number
from tidemark.operators import casebits, cascade, detect, features, forest, hl_log, link, overlap, participation, paths, stats, steps, windows
from tidemark.sources import attributes, document, logs, xes
from tidemark.storage import Staging

from . import sql
from .analyses import Prepared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = [*features.ENTITY, "w1", "w2"]
VALUE = [*KEYS, "value", "n"]
#: Overlaps asked for on the small test log, where cases are few, and links on its dense one.
OVERLAP, LINK = 0.3, 0.9


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.from_events(spark, sf_dir)


def _day(spark: SparkSession, sf_dir: str) -> Prepared:
    """The log and its steps by day. Its events never tie, so the total order gives the steps."""
    log = _log(spark, sf_dir)
    f = windows.frame(log, "days")
    return Prepared(windows.with_windows(log, f), windows.steps_with_windows(steps.total_order(log), f), f)


def _staged_day(spark: SparkSession, sf_dir: str) -> Prepared:
    """The same, written once: each feature is a branch of the plan, and links read it too."""
    p, stage = _day(spark, sf_dir), Staging(spark, "day")
    return Prepared(stage.table(p.log, "log"), stage.table(p.steps, "steps"), p.frame)


def _values(spark: SparkSession, sf_dir: str, chosen: tuple[str, ...], p: Prepared | None = None) -> DataFrame:
    p = p or (_staged_day if len(chosen) > 2 else _day)(spark, sf_dir)
    return features.values(chosen, p.log, p.steps, p.frame)


def _hles(spark: SparkSession, sf_dir: str, chosen: tuple[str, ...], by: str = "type", traffic: tuple[str, ...] = ("High",), p: Prepared | None = None) -> DataFrame:
    values = Staging(spark, "values").table(_values(spark, sf_dir, chosen, p), "values")
    return Staging(spark, "hles").table(detect.detect(values, detect.thresholds(values, 0.9, by), traffic, by), "hles")


def _joined(c: str, mark: str = ">") -> Column:
    return F.array_join(F.col(c).cast("array<string>"), mark)


STEP = "case_id, pos_i, pos_j, a_i, a_j, r_i, r_j"


@query("event_table", sql.query("SELECT case_id, pos, act, res, us, count(*) OVER (PARTITION BY case_id) = 1 AS single FROM log", "log"))
def event_table(spark, sf_dir):
    return logs.event_table(_log(spark, sf_dir))


@query("event_table_no_resource", sql.query("SELECT case_id, pos, act, us, count(*) OVER (PARTITION BY case_id) = 1 AS single FROM log", "log"))
def event_table_no_resource(spark, sf_dir):
    return logs.event_table(_log(spark, sf_dir), with_resource=False)


def _document(spark: SparkSession, sf_dir: str) -> str:
    """The log as one XES document in the shared folder; resources and values also three levels deep."""
    log = _log(spark, sf_dir)
    nested = F.struct(F.struct(F.col("res").alias("name"), F.array("value").alias("values")).alias("by"))
    path = Staging(spark, "document").path("log.xes")
    document.write_document(log.withColumn("nested", nested), path, {"nested": "made"})
    return path


@query("xes_document", sql.query("SELECT case_id, pos, act, res, us FROM log", "log"))
def xes_document(spark, sf_dir):
    """The log, read again from its document."""
    return xes.read_xes(spark, _document(spark, sf_dir)).select(F.col("case_name").cast("long").alias("case_id"), "pos", "act", "res", "us")


@query("xes_attributes", sql.query("SELECT l.case_id, l.pos, l.res AS name, l.value FROM log l", "log"))
def xes_attributes(spark, sf_dir):
    """Attributes three levels deep, by event, with the names of their traces: all are rows of one read."""
    rows = attributes.read_attributes(spark, _document(spark, sf_dir))
    keys = {"case": ("concept:name",), "name": ("made", "by", "name"), "value": ("made", "by", "values", "item")}
    at = {name: F.col("keys") == F.array(*[F.lit(k) for k in path]) for name, path in keys.items()}
    # an event's own row stands for it where it has none of them
    mine = F.when(F.col("pos").isNull(), at["case"]).otherwise(F.col("kind").isNull() | at["name"] | at["value"])
    wanted = rows.filter("owner in ('trace', 'event')").filter(mine).groupBy("trace", "pos").agg(*[F.max(F.when(c, F.col("value"))).alias(name) for name, c in at.items()])
    wanted = Staging(spark, "attributes").table(wanted, "wanted")  # both sides of the join read it: the document is parsed once
    cases = wanted.filter("pos is null").select("trace", F.col("case").cast("long").alias("case_id"))
    return wanted.filter("pos is not null").join(cases, "trace").select("case_id", "pos", "name", F.col("value").cast("double").alias("value"))


@query("steps_total_order", sql.query(f"SELECT {STEP} FROM steps", "steps"))
def steps_total_order(spark, sf_dir):
    return steps.total_order(_log(spark, sf_dir)).select(STEP.split(", "))


@query("steps_partial_order", sql.query(f"SELECT {STEP} FROM posteps", "posteps"))
def steps_partial_order(spark, sf_dir):
    return steps.partial_order(logs.from_events(spark, sf_dir, "day")).select(STEP.split(", "))


@query("triggers", sql.query("SELECT case_id, pos_i AS pos, array_to_string(list_transform(list_sort(list(DISTINCT pos_j)), lambda x: CAST(x AS VARCHAR)), ',') AS triggers FROM posteps GROUP BY ALL", "posteps"))
def triggers(spark, sf_dir):
    return steps.triggers(steps.partial_order(logs.from_events(spark, sf_dir, "day"))).withColumn("triggers", _joined("triggers", ","))


@query("releases", sql.query("SELECT case_id, pos_j AS pos, array_to_string(list_transform(list_sort(list(DISTINCT pos_i)), lambda x: CAST(x AS VARCHAR)), ',') AS releases FROM posteps GROUP BY ALL", "posteps"))
def releases(spark, sf_dir):
    return steps.releases(steps.partial_order(logs.from_events(spark, sf_dir, "day"))).withColumn("releases", _joined("releases", ","))


@query("trace_finals", sql.query("SELECT case_id, pos, act, res FROM finals", "finals"))
def trace_finals(spark, sf_dir):
    log = _log(spark, sf_dir)
    return steps.finals(log, steps.total_order(log)).select("case_id", "pos", "act", "res")


@query("components", sql.query("SELECT DISTINCT * FROM (SELECT 'activity' AS comp_type, act AS e1, NULL AS e2 FROM log UNION ALL SELECT 'segment', a_i, a_j FROM steps UNION ALL SELECT 'resource', res, NULL FROM log)", "log", "steps"))
def components(spark, sf_dir):
    log = _log(spark, sf_dir)
    return steps.components(log, steps.total_order(log))


@query("frequent_segments", sql.query("SELECT a_i, a_j, c AS n FROM segs WHERE c >= (SELECT quantile_cont(c, 0.8) FROM segs)", "segs"))
def frequent_segments(spark, sf_dir):
    return steps.frequent_segments(_log(spark, sf_dir), 0.8)


@query("surviving_steps", sql.query(f"SELECT {STEP} FROM steps SEMI JOIN (SELECT * FROM segs WHERE c >= (SELECT quantile_cont(c, 0.8) FROM segs)) USING (a_i, a_j)", "steps", "segs"))
def surviving_steps(spark, sf_dir):
    log = _log(spark, sf_dir)
    return steps.surviving_steps(steps.total_order(log), steps.frequent_segments(log, 0.8)).select(STEP.split(", "))


@query("select_activities", sql.query(f"SELECT {STEP} FROM steps WHERE a_i IN ('view', 'click') AND a_j IN ('view', 'click')", "steps"))
def select_activities(spark, sf_dir):
    return steps.select_activities(steps.total_order(_log(spark, sf_dir)), ["view", "click"]).select(STEP.split(", "))


@query("select_resources", sql.query("SELECT case_id, pos, act, res, us FROM log WHERE res IN ('R0', 'R1')", "log"))
def select_resources(spark, sf_dir):
    return steps.select_resources(_log(spark, sf_dir), ["R0", "R1"]).select("case_id", "pos", "act", "res", "us")


@query("case_filter", sql.query("SELECT case_id, pos, act FROM log WHERE case_id IN (SELECT case_id FROM log WHERE act IN ('R', 'purchase') AND us % 5 = 0) ORDER BY 1, 2", "log"))
def case_filter(spark, sf_dir):
    log = _log(spark, sf_dir)
    marked = log.withColumn("act", F.when((F.col("act") == "purchase") & (F.col("us") % 5 == 0), "A_Pending").otherwise(F.col("act")))
    kept = steps.cases_with(marked, ["A_Pending", "A_Cancelled", "A_Denied"])
    return kept.select("case_id", "pos", F.when(F.col("act") == "A_Pending", "purchase").otherwise(F.col("act")).alias("act"))


@query("lifecycle_relabel", sql.query("SELECT case_id, pos, CASE WHEN act LIKE 'v%' THEN act || '|' || res ELSE act END AS act FROM log", "log"))
def lifecycle_relabel(spark, sf_dir):
    return steps.relabel_lifecycle(_log(spark, sf_dir), "v", "res").select("case_id", "pos", "act")


@query("resource_selection", sql.query("SELECT DISTINCT res FROM log WHERE res <> 'R1'", "log"))
def resource_selection(spark, sf_dir):
    return steps.resources_except(_log(spark, sf_dir), ["R1"])


@query("control_flow", sql.query("SELECT case_id, array_to_string(flow, '>') AS flow FROM flows", "flows"))
def control_flow(spark, sf_dir):
    return steps.control_flow(_log(spark, sf_dir)).withColumn("flow", _joined("flow"))


def _unit(unit: str) -> None:
    oracle = sql.query(f"SELECT case_id, pos, {sql.number('us', unit)} - {sql.number('lo', unit)} AS w FROM log, bounds", "log", "bounds")

    @query(f"win_{unit}", oracle)
    def by_unit(spark, sf_dir):
        log = _log(spark, sf_dir)
        return windows.with_windows(log, windows.frame(log, unit)).select("case_id", "pos", "w")


for _u in ("days", "hours", "minutes"):
    _unit(_u)
_SIZE = "SELECT lo / 1e6 AS start, greatest(1, ceil((hi / 1e6 - lo / 1e6) / 12)) AS size, hi / 1e6 AS stop FROM bounds"


@query("win_by_count", sql.query(f"SELECT case_id, pos, CAST(least(floor((us / 1e6 - start) / size), greatest(1, ceil((stop - start) / size)) - 1) AS BIGINT) AS w FROM log, ({_SIZE})", "log", "bounds"))
def win_by_count(spark, sf_dir):
    log = _log(spark, sf_dir)
    return windows.with_windows(log, windows.frame(log, 12)).select("case_id", "pos", "w")


@query("win_by_count_reference", sql.query(f"SELECT case_id, pos, CAST(least(floor((us / 1e6 - start) / size), ceil((stop - start) / size) - 2) AS BIGINT) AS w FROM log, ({_SIZE})", "log", "bounds"))
def win_by_count_reference(spark, sf_dir):
    log = _log(spark, sf_dir)
    return windows.with_windows(log, windows.frame(log, 12, "reference")).select("case_id", "pos", "w")


def _borders(name: str, unit: str, compat: str, back: int) -> None:
    n = sql.UNIT[unit][1] // 1_000_000
    lo, hi = sql.number("lo", unit), sql.number("hi", unit)
    oracle = sql.query(f"SELECT w, CAST((u + w - {back}) * {n} AS DOUBLE) AS left_s, CAST((u + w - {back} + 1) * {n} AS DOUBLE) AS right_s FROM (SELECT {lo} AS u, unnest(range(0, {hi} - {lo} + 1)) AS w FROM bounds)", "bounds")

    @query(name, oracle)
    def borders(spark, sf_dir):
        return windows.frame(_log(spark, sf_dir), unit, compat).borders(spark)


@query("win_borders_by_count", sql.query(f"SELECT w, start + w * size AS left_s, start + (w + 1) * size AS right_s FROM (SELECT *, unnest(range(0, CAST(greatest(1, ceil((stop - start) / size)) AS BIGINT))) AS w FROM ({_SIZE}))", "bounds"))
def win_borders_by_count(spark, sf_dir):
    return windows.frame(_log(spark, sf_dir), 12).borders(spark)


_borders("win_borders_days", "days", "fixed", 0)
_borders("win_borders_days_reference", "days", "reference", 1)
_borders("win_borders_hours", "hours", "fixed", 1)


@query("seconds_and_back", sql.query("SELECT case_id, pos, us / 1e6 AS seconds, us AS us_again, CAST(floor(us / 86400000000.0) AS BIGINT) AS day FROM log", "log"))
def seconds_and_back(spark, sf_dir):
    from tidemark.functions.units import seconds, timestamp

    log = _log(spark, sf_dir)
    return log.select("case_id", "pos", seconds(F.col("us")).alias("seconds"), F.unix_micros(timestamp(seconds(F.col("us")))).alias("us_again"), unit_number(F.col("us"), "days").alias("day"))


def _feature(f_type: str) -> None:
    n = sql.name(f_type)

    @query(f"feature_{n}", sql.query(f"SELECT {', '.join(VALUE)} FROM v_{n}", f"v_{n}"))
    def value(spark, sf_dir):
        return _values(spark, sf_dir, (f_type,)).select(VALUE)


for _f in features.FEATURES:
    _feature(_f)


#: A choice of entities for both analyses.
CHOSEN = features.Scope(("view", "click"), ("R0", "R1"))


def _selected(f_type: str, where: str) -> None:
    n = sql.name(f_type)

    @query(f"feature_{n}_selected", sql.query(f"SELECT {', '.join(VALUE)} FROM v_{n} WHERE {where}", f"v_{n}"))
    def value(spark, sf_dir):
        p = _day(spark, sf_dir)
        return features.values((f_type,), p.log, p.steps, p.frame, scope=CHOSEN).select(VALUE)


for _f, _where in {"exec": "e1 IN ('view', 'click')", "do": "e1 IN ('R0', 'R1')", "enter": "e1 IN ('view', 'click') AND e2 IN ('view', 'click')", "handover": "e1 IN ('view', 'click') AND e2 IN ('view', 'click')"}.items():
    _selected(_f, _where)
_FREQUENT = "SEMI JOIN (SELECT a_i AS e1, a_j AS e2 FROM segs WHERE c >= (SELECT quantile_cont(c, 0.8) FROM segs)) USING (e1, e2)"


def _reduced(f_type: str, which: str) -> None:
    n = sql.name(f_type)

    @query(f"feature_{n}_frequent_segments", sql.query(f"SELECT {', '.join(VALUE)} FROM v_{n} {which}", f"v_{n}", "segs"))
    def value(spark, sf_dir):
        p = _day(spark, sf_dir)
        scope = features.Scope(segments=steps.frequent_segments(_log(spark, sf_dir), 0.8))
        return features.values((f_type,), p.log, p.steps, p.frame, scope=scope).select(VALUE)


for _f, _which in {"todo": "", "busy": "", "enter": _FREQUENT, "batch": _FREQUENT}.items():
    _reduced(_f, _which)


def _tied_reference(f_type: str, rows: str) -> None:
    """Reference mode on a log whose times tie by day: events count once for each of their steps."""
    name = sql.name(f_type)

    @query(f"feature_{name}_reference", sql.query(f"SELECT '{f_type}' AS f_type, e1, w1, CAST(count(*) AS DOUBLE) AS value FROM ({rows}) GROUP BY e1, w1", "wt_steps", "wt_ends"))
    def value(spark, sf_dir):
        log = logs.from_events(spark, sf_dir, "day")
        f = windows.frame(log, "days")
        made = windows.steps_with_windows(steps.partial_order(log), f)
        return features.values((f_type,), windows.with_windows(log, f), made, f, "reference").select("f_type", "e1", "w1", "value")


_DONE = "SELECT {s} AS e1, w_i AS w1 FROM wt_steps UNION ALL SELECT {e}, w FROM wt_ends"
_tied_reference("exec", _DONE.format(s="a_i", e="act"))
_tied_reference("do", _DONE.format(s="r_i", e="res"))
_tied_reference("busy", _DONE.format(s="r_i", e="res") + " UNION ALL SELECT r_j, unnest(range(w_i, w_j)) FROM wt_steps WHERE w_i < w_j")


@query("feature_to_exec_reference", sql.query("SELECT 'to-exec' AS f_type, 'activity' AS comp_type, e AS e1, NULL AS e2, w AS w1, w AS w2, 1.0 + coalesce(value, 0) AS value FROM (SELECT e, w FROM acts, (SELECT unnest(range(0, (SELECT max(w) + 1 FROM wl))) AS w)) g LEFT JOIN v_to_exec v ON v.e1 = g.e AND v.w1 = g.w", "acts", "wl", "v_to_exec"))
def feature_to_exec_reference(spark, sf_dir):
    p = _day(spark, sf_dir)
    return features.values(("to-exec",), p.log, p.steps, p.frame, "reference").select(*KEYS, "value")


def _detected(by: str) -> None:
    short = ["f_type", "comp_type"] + (["e1", "e2"] if by == "entity" else [])

    @query(f"thresholds_by_{by}", sql.query(f"SELECT {', '.join(short)}, low, high FROM log_limits_{by}", f"log_limits_{by}"))
    def limits(spark, sf_dir):
        return detect.thresholds(_values(spark, sf_dir, features.LOG_FEATURES), 0.9, by).select(*short, "low", "high")

    @query(f"hle_high_by_{by}", sql.query(f"SELECT hle_id, {', '.join(VALUE)}, class FROM log_hles_{by}", f"log_hles_{by}"))
    def high(spark, sf_dir):
        return _hles(spark, sf_dir, features.LOG_FEATURES, by).select("hle_id", *VALUE, "class")

    @query(f"hle_paths_by_{by}", sql.query(f"SELECT hle_id, {', '.join(VALUE)}, class FROM path_hles_{by}", f"path_hles_{by}"))
    def delays(spark, sf_dir):
        return _hles(spark, sf_dir, features.PATH_FEATURES, by).select("hle_id", *VALUE, "class")

    @query(f"thresholds_delay_by_{by}", sql.query(f"SELECT {', '.join(short)}, low, high, bundle FROM path_limits_{by} WHERE f_type = 'delay'", f"path_limits_{by}"))
    def bundles(spark, sf_dir):
        return detect.thresholds(_values(spark, sf_dir, ("delay",)), 0.9, by).filter("f_type = 'delay'").select(*short, "low", "high", "bundle")


for _by in ("type", "entity"):
    _detected(_by)


@query("hle_low", sql.query(f"SELECT * FROM ({sql.hles('path_values', 'path_limits_type', 'type', ('Low',)).replace('SELECT *, concat_ws', 'SELECT f_type, comp_type, e1, e2, w1, w2, value, concat_ws', 1)})", "path_values", "path_limits_type"))
def hle_low(spark, sf_dir):
    return _hles(spark, sf_dir, features.PATH_FEATURES, "type", ("Low",)).select(*KEYS, "value", "hle_id")


@query(
    "hle_low_zeros",
    sql.query(
        "SELECT f_type, comp_type, e1, e2, w1, 0.0 AS value FROM (SELECT DISTINCT f_type, comp_type, e1, e2 FROM log_values WHERE (f_type, comp_type) IN (SELECT (f_type, comp_type) FROM log_limits_type WHERE low > 0)) g, (SELECT unnest(range(0, (SELECT max(w) + 1 FROM wl))) AS w1) ANTI JOIN log_values v ON v.f_type = g.f_type AND v.e1 = g.e1 AND v.e2 IS NOT DISTINCT FROM g.e2 AND v.w1 = w1".replace(
            "(SELECT unnest(range(0, (SELECT max(w) + 1 FROM wl))) AS w1) ANTI JOIN log_values v ON", "(SELECT unnest(range(0, (SELECT max(w) + 1 FROM wl))) AS w1) q WHERE NOT EXISTS (SELECT 1 FROM log_values v WHERE"
        ).replace("v.w1 = w1", "v.w1 = q.w1)"),
        "log_values",
        "log_limits_type",
        "wl",
    ),
)
def hle_low_zeros(spark, sf_dir):
    p = _day(spark, sf_dir)
    values = Staging(spark, "values").table(features.values(features.LOG_FEATURES, p.log, p.steps, p.frame), "values")
    return detect.low_zeros(values, detect.thresholds(values, 0.9), p.frame.borders(spark)).select(*KEYS[:-1], "value")


@query("hle_case_sets", sql.query("SELECT hle_id, array_to_string(list_transform(cases, lambda x: CAST(x AS VARCHAR)), ',') AS cases FROM sets", "sets"))
def hle_case_sets(spark, sf_dir):
    p = _staged_day(spark, sf_dir)
    return detect.case_sets(_hles(spark, sf_dir, features.PATH_FEATURES, p=p), features.all_instances(features.PATH_FEATURES, p.log, p.steps, p.frame)).withColumn("cases", _joined("cases", ","))


_HLA = "SELECT f_type, comp_type, e1, e2, class, count(*) AS frequency FROM log_hles_type GROUP BY ALL"


@query("hla_frequencies", sql.query(_HLA, "log_hles_type"))
def hla_frequencies(spark, sf_dir):
    return detect.hla_counts(_hles(spark, sf_dir, features.LOG_FEATURES))


@query("hla_filter_percentile", sql.query(f"SELECT * FROM ({_HLA}) WHERE frequency >= (SELECT quantile_cont(frequency, 0.8) FROM ({_HLA}))", "log_hles_type"))
def hla_filter_percentile(spark, sf_dir):
    return detect.filter_hla(_hles(spark, sf_dir, features.LOG_FEATURES), 0.8)


def _top(name: str, compat: str, order: str) -> None:
    @query(name, sql.query(f"SELECT * FROM ({_HLA}) ORDER BY frequency {order}, f_type, comp_type, e1, e2 NULLS FIRST, class LIMIT 7", "log_hles_type"))
    def top(spark, sf_dir):
        return detect.filter_hla(_hles(spark, sf_dir, features.LOG_FEATURES), 7, compat)


_top("hla_filter_top", "fixed", "DESC")
_top("hla_filter_top_reference", "reference", "ASC")


def _linked(kind: str) -> None:
    @query(f"link_{kind}", sql.query(f"SELECT '{kind}' AS kind, x1, x2, y1, y2, round(v, 9) AS weight FROM l_{kind}", f"l_{kind}"))
    def raw(spark, sf_dir):
        log = _log(spark, sf_dir)
        return link.raw_links(kind, log, steps.total_order(log)).withColumn("weight", F.round("weight", 9))


for _k in link.KINDS:
    _linked(_k)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return link.links(log, steps.total_order(log))


@query("link_normalised", sql.query("SELECT * FROM links", "links"))
def link_normalised(spark, sf_dir):
    return _links(spark, sf_dir).select("kind", *link.PAIR, "weight")


@query("link_symmetric", sql.query("SELECT DISTINCT * FROM (SELECT * FROM links UNION ALL SELECT kind, y1, y2, x1, x2, weight FROM links)", "links"))
def link_symmetric(spark, sf_dir):
    return link.symmetric(_links(spark, sf_dir).select("kind", *link.PAIR, "weight"))


@query("link_spread", sql.query("SELECT * FROM spread", "spread"))
def link_spread(spark, sf_dir):
    return link.spread(_links(spark, sf_dir))


@query("cascade_edges", sql.query("SELECT * FROM strong", "strong"))
def cascade_edges(spark, sf_dir):
    return cascade.edges(_hles(spark, sf_dir, features.LOG_FEATURES), link.spread(_links(spark, sf_dir)), LINK)


def _cascades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _staged_day(spark, sf_dir)
    found = _hles(spark, sf_dir, features.LOG_FEATURES, p=p)
    return found, cascade.cascades(found, link.spread(link.links(p.log, p.steps)), LINK)


@query("cascade_id", sql.query("SELECT * FROM cascades", "cascades"))
def cascade_id(spark, sf_dir):
    return _cascades(spark, sf_dir)[1]


@query("hl_log_partial", sql.query('SELECT "cascade" AS "case", activity, (d + w1) * 86400.0 AS left_s, value, comp_type AS component FROM labelled, (SELECT ' + sql.number("lo") + " AS d FROM bounds)", "labelled", "bounds"))
def hl_log_partial(spark, sf_dir):
    found, cascades = _cascades(spark, sf_dir)
    return hl_log.partial_order_log(found, cascades, detect.filter_hla(found, 0), windows.frame(_log(spark, sf_dir)))


_FLAT = "SELECT \"cascade\" AS \"case\", activity, round((d + w1) * 86400.0 + CAST(row_number() OVER (PARTITION BY w1 ORDER BY activity, hle_id) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY w1) * 86400.0, 3) AS at_s, value, comp_type AS component FROM labelled, (SELECT " + sql.number("lo") + " AS d FROM bounds)"


@query("hl_log_flat", sql.query(_FLAT, "labelled", "bounds"))
def hl_log_flat(spark, sf_dir):
    found, cascades = _cascades(spark, sf_dir)
    return hl_log.flat_log(found, cascades, detect.filter_hla(found, 0), windows.frame(_log(spark, sf_dir))).withColumn("at_s", F.round("at_s", 3))


_FLAT_REFERENCE = "SELECT \"cascade\" AS \"case\", l.activity, round((d + w1) * 86400.0 + CAST(i - 1 AS DOUBLE) / n * 86400.0, 3) AS at_s, value, component FROM (SELECT \"cascade\", w1, value, comp_type AS component, row_number() OVER (PARTITION BY w1 ORDER BY hle_id) AS i, count(*) OVER (PARTITION BY w1) AS n FROM labelled) JOIN (SELECT w1, activity, row_number() OVER (PARTITION BY w1 ORDER BY activity, hle_id) AS i FROM labelled) l USING (w1, i), (SELECT " + sql.number("lo") + " AS d FROM bounds)"


@query("hl_log_flat_reference", sql.query(_FLAT_REFERENCE, "labelled", "bounds"))
def hl_log_flat_reference(spark, sf_dir):
    found, cascades = _cascades(spark, sf_dir)
    return hl_log.flat_log(found, cascades, detect.filter_hla(found, 0), windows.frame(_log(spark, sf_dir)), compat="reference").withColumn("at_s", F.round("at_s", 3))


@query("hle_spread", sql.query("SELECT hle_id, start_first, start_last, end_first, end_last FROM spans", "spans"))
def hle_spread(spark, sf_dir):
    return overlap.spreads(_hles(spark, sf_dir, features.PATH_FEATURES)).select("hle_id", "start_first", "start_last", "end_first", "end_last")


def _overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = _staged_day(spark, sf_dir)
    found = _hles(spark, sf_dir, features.PATH_FEATURES, p=p)
    stage = Staging(spark, "overlaps")
    cases = stage.table(detect.case_rows(found, features.all_instances(features.PATH_FEATURES, p.log, p.steps, p.frame)), "cases")
    return found, cases, stage.table(overlap.arcs(overlap.spreads(found), cases, OVERLAP), "arcs")


@query("hle_overlap_edges", sql.query("SELECT * FROM arcs", "arcs"))
def hle_overlap_edges(spark, sf_dir):
    return _overlaps(spark, sf_dir)[2]


@query("overlap_components", sql.query("SELECT a AS hle_id, min(b) AS component FROM joined GROUP BY a", "joined"))
def overlap_components(spark, sf_dir):
    found, _, arcs = _overlaps(spark, sf_dir)
    return cascade.components_of(arcs, found)


@query("hle_table", sql.query("SELECT hle_id AS \"hle-id\", f_type AS type, e1 || ',' || e2 AS segment, f_type || ':' || e1 || ',' || e2 AS activity, value, CASE WHEN w1 = w2 THEN CAST(w1 AS VARCHAR) ELSE w1 || ',' || w2 END AS \"window\" FROM path_hles_type", "path_hles_type"))
def hle_table(spark, sf_dir):
    from .analyses import hle_table as table

    return table(_hles(spark, sf_dir, features.PATH_FEATURES))


@query("time_overlaps", sql.query("SELECT a.hle_id AS src, b.hle_id AS dst FROM spans a JOIN spans b ON a.e2 = b.e1 AND a.e1 = 'view' AND a.end_first <= b.start_last AND b.start_first <= a.end_last", "spans"))
def time_overlaps(spark, sf_dir):
    found = overlap.spreads(_hles(spark, sf_dir, features.PATH_FEATURES))
    a = found.filter("e1 = 'view'").select(F.col("hle_id").alias("src"), F.col("e2").alias("at"), "end_first", "end_last")
    b = found.select(F.col("hle_id").alias("dst"), F.col("e1").alias("at"), "start_first", "start_last")
    return a.join(b, "at").filter(overlap.windows_overlap("end_first", "end_last", "start_first", "start_last")).select("src", "dst")


def _paths(spark: SparkSession, sf_dir: str, only_maximal: bool = True) -> tuple[DataFrame, forest.Found]:
    found, cases, arcs = _overlaps(spark, sf_dir)
    numbers = Staging(spark, "cases").table(casebits.numbered(_log(spark, sf_dir)), "numbers")
    return found, forest.grow(found.select("hle_id"), arcs, cases, OVERLAP, only_maximal, numbers=numbers)


_CASES = "array_to_string(list_transform(list_sort(cases), lambda x: CAST(x AS VARCHAR)), ',') AS cases"


@query("hle_paths", sql.query(f"SELECT array_to_string(path, '>') AS path, {_CASES} FROM ended", "ended"))
def hle_paths(spark, sf_dir):
    return _paths(spark, sf_dir)[1].listing().select(_joined("path").alias("path"), F.array_join(F.sort_array("cases").cast("array<string>"), ",").alias("cases"))


_PAIRS = """SELECT array_to_string(path, '>') AS path, cases FROM ended UNION ALL
 SELECT w.path[len(w.path) - 1] || '>' || w.last, list_intersect(a.cases, b.cases) FROM walk w JOIN sets a ON a.hle_id = w.path[len(w.path) - 1] JOIN sets b ON b.hle_id = w.last WHERE len(w.path) > 1"""


@query("hle_paths_and_arcs", sql.query(f"SELECT path, {_CASES} FROM ({_PAIRS})", "ended", "walk", "sets"))
def hle_paths_and_arcs(spark, sf_dir):
    """Not maximal paths alone: each arc by which a path grew too, as often as it did."""
    return _paths(spark, sf_dir, only_maximal=False)[1].listing().select(_joined("path").alias("path"), F.array_join(F.sort_array("cases").cast("array<string>"), ",").alias("cases"))


@query("pruned_arcs", sql.query("SELECT * FROM arcs WHERE overlap >= 0.4", "arcs"))
def pruned_arcs(spark, sf_dir):
    return paths.prune_arcs(_overlaps(spark, sf_dir)[2], 0.4)


def _hla(spark: SparkSession, sf_dir: str) -> participation.Activities:
    found, all_paths = _paths(spark, sf_dir)
    return participation.activities_of(all_paths, found)


def _shown(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(x["f_type"], F.lit(":"), x["e1"], F.lit(","), x["e2"])), ">")


@query("hla_paths", sql.query(f"SELECT path, frequency, {_CASES} FROM hla", "hla"))
def hla_paths(spark, sf_dir):
    return _hla(spark, sf_dir).listing().select(_shown("hla_path").alias("path"), "frequency", _joined("cases", ",").alias("cases"))


@query("hla_paths_frequent", sql.query("SELECT path, frequency FROM hla WHERE frequency >= 3", "hla"))
def hla_paths_frequent(spark, sf_dir):
    return _hla(spark, sf_dir).frequent(3).table.select(_shown("hla_path").alias("path"), "frequency")


@query("maximal_paths", sql.query("SELECT DISTINCT array_to_string(path, '>') AS path FROM walk w WHERE NOT EXISTS (SELECT 1 FROM walk v WHERE len(v.path) > len(w.path) AND v.path[1:len(w.path)] = w.path)", "walk"))
def maximal_paths(spark, sf_dir):
    return paths.maximal(_paths(spark, sf_dir)[1].paths).select(_joined("path").alias("path")).distinct()


_STATS = """SELECT h.path, h.length, h.frequency, (SELECT count(DISTINCT p.case_id) FROM pool p WHERE p.path = h.path) AS n_relevant, len(h.cases) AS n_participating,
 (SELECT count(DISTINCT p.case_id) FROM pool p WHERE p.path = h.path AND NOT list_contains(h.cases, p.case_id)) AS n_non_participating FROM hla h"""


def _statistics(spark: SparkSession, sf_dir: str) -> participation.Statistics:
    return participation.statistics(_hla(spark, sf_dir), _log(spark, sf_dir))


@query("path_statistics", sql.query(_STATS, "hla", "pool"))
def path_statistics(spark, sf_dir):
    return _statistics(spark, sf_dir).table.select(_shown("path").alias("path"), "length", "frequency", "n_relevant", "n_participating", "n_non_participating")


@query("hles_by_case", sql.query("SELECT case_id, array_to_string(list_sort(list(hle_id)), ';') AS hles FROM (SELECT hle_id, unnest(cases) AS case_id FROM sets) GROUP BY case_id", "sets"))
def hles_by_case(spark, sf_dir):
    return paths.hles_by_case(_overlaps(spark, sf_dir)[1]).withColumn("hles", _joined("hles", ";"))


@query("throughput_partition", sql.query("SELECT * FROM parts_time", "parts_time"))
def throughput_partition(spark, sf_dir):
    return stats.throughput_partition(_log(spark, sf_dir))


@query("outcome_partition", sql.query("SELECT * FROM parts_outcome", "parts_outcome"))
def outcome_partition(spark, sf_dir):
    return stats.outcome_partition(_log(spark, sf_dir), "purchase")


@query("amount_partition", sql.query("SELECT case_id, CASE WHEN amount <= 3000 THEN 0 ELSE 1 END AS part FROM (SELECT case_id, round(sum(value), 4) AS amount FROM log GROUP BY case_id)", "log"))
def amount_partition(spark, sf_dir):
    amounts = _log(spark, sf_dir).groupBy("case_id").agg(F.round(F.sum("value"), 4).alias("amount"))
    return stats.amount_partition(amounts, "amount", 3000)


_CELLS = ", ".join(f"count(DISTINCT CASE WHEN {w} AND t.part = {p} THEN t.case_id END) AS n{r}{p}" for r, w in ((0, "r = 0"), (1, "r = 1")) for p in (0, 1, 2))
_TABLE = f"SELECT h.path, {_CELLS} FROM hla h LEFT JOIN (SELECT path, unnest(cases) AS case_id, 0 AS r FROM hla UNION ALL SELECT p.path, p.case_id, 1 AS r FROM pool p JOIN hla g ON g.path = p.path WHERE NOT list_contains(g.cases, p.case_id)) x ON x.path = h.path LEFT JOIN parts_time t ON t.case_id = x.case_id GROUP BY h.path"
_EXPECTED = "((n{r}0 + n{r}1 + n{r}2) * CAST(n0{c} + n1{c} AS DOUBLE) / nullif(n00 + n01 + n02 + n10 + n11 + n12, 0))"
_CHI = " + ".join(f"CASE WHEN {_EXPECTED.format(r=r, c=c)} > 0 THEN (n{r}{c} - {_EXPECTED.format(r=r, c=c)}) * (n{r}{c} - {_EXPECTED.format(r=r, c=c)}) / {_EXPECTED.format(r=r, c=c)} ELSE 0 END" for r in (0, 1) for c in (0, 1, 2))


@query("chi_square", sql.query(f"SELECT path, n00, n01, n02, n10, n11, n12, round(CASE WHEN n00 + n01 + n02 + n10 + n11 + n12 = 0 THEN NULL ELSE {_CHI} END, 6) AS chi_square, round(exp(-(CASE WHEN n00 + n01 + n02 + n10 + n11 + n12 = 0 THEN NULL ELSE {_CHI} END) / 2), 6) AS p FROM ({_TABLE})", "hla", "pool", "parts_time"))
def chi_square(spark, sf_dir):
    found = stats.significance(_statistics(spark, sf_dir), stats.throughput_partition(_log(spark, sf_dir)), 3)
    cells = [F.col("table")[r][p].alias(f"n{r}{p}") for r in (0, 1) for p in (0, 1, 2)]
    return found.select(_shown("path").alias("path"), *cells, F.round("chi_square", 6).alias("chi_square"), F.round("p", 6).alias("p"))


_RESULT = f"SELECT h.length, h.frequency, path, n00 AS part_a, n01 AS part_b, n02 AS part_c, n10 AS nonpart_a, n11 AS nonpart_b, n12 AS nonpart_c, round(exp(-({_CHI}) / 2), 6) AS p FROM ({_TABLE}) JOIN (SELECT path, length, frequency FROM hla) h USING (path) WHERE n00 + n01 + n02 + n10 + n11 + n12 > 0 AND round(exp(-({_CHI}) / 2), 9) <= 0.5"


@query("result_table", sql.query(_RESULT, "hla", "pool", "parts_time"))
def result_table(spark, sf_dir):
    """At a level of 0.5, as the test log's paths depend on nothing."""
    found = stats.result_table(_statistics(spark, sf_dir), stats.throughput_partition(_log(spark, sf_dir)), 3, ["a", "b", "c"], 0.5)
    return found.withColumns({"path": _shown("path"), "p": F.round("p", 6)})


_lg = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"
_FISHER = f"""SELECT path, round(least(1.0, sum(exp(l)) FILTER (l <= here + 1e-7)), 6) AS p, round(least(1.0, sum(exp(l)) FILTER (l <= here + 1e-7)), 9) <= 0.05 AS significant FROM (
 SELECT path, {_lg("r", "x")} + {_lg("s", "(n - x)")} - {_lg("(r + s)", "n")} AS l, {_lg("r", "a")} + {_lg("s", "(n - a)")} - {_lg("(r + s)", "n")} AS here FROM (
 SELECT path, a, r, s, n, unnest(range(greatest(0, n - s), least(r, n) + 1)) AS x FROM (SELECT path, n00 AS a, n00 + n01 AS r, n10 + n11 AS s, n00 + n10 AS n FROM ({_TABLE.replace("parts_time t", "(SELECT case_id, CASE WHEN floor((max(us) - min(us)) / 86400000000.0) <= 28 THEN 0 ELSE 1 END AS part FROM log GROUP BY case_id) t")})))) GROUP BY path"""


@query("fisher_exact", sql.query(_FISHER, "hla", "pool", "log"))
def fisher(spark, sf_dir):
    found = stats.significance(_statistics(spark, sf_dir), stats.throughput_partition(_log(spark, sf_dir), (28, 29)).withColumn("part", F.least("part", F.lit(1))), 2, "fisher")
    return found.select(_shown("path").alias("path"), F.round("p", 6).alias("p"), "significant")


@query("contiguous_runs", sql.query("SELECT case_id, len(list_filter(range(1, len(flow) + 1), lambda i: flow[i:i + 2] = ['view', 'click', 'purchase'])) > 0 AS has_run FROM flows", "flows"))
def contiguous_runs(spark, sf_dir):
    run = F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))
    return steps.control_flow(_log(spark, sf_dir)).select("case_id", contains_run(F.col("flow"), run).alias("has_run"))


@query("case_jaccard", sql.query("SELECT hle_id, round(CAST(len(list_intersect(cases, [1, 2, 3, 4, 5])) AS DOUBLE) / len(list_distinct(list_concat(cases, [1, 2, 3, 4, 5]))), 9) AS overlap FROM sets", "sets"))
def case_jaccard(spark, sf_dir):
    sets = _overlaps(spark, sf_dir)[1].groupBy("hle_id").agg(F.collect_list("case_id").alias("cases"))
    return sets.select("hle_id", F.round(jaccard(F.col("cases"), F.array(*[F.lit(i).cast("long") for i in range(1, 6)])), 9).alias("overlap"))


def enter_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: days on which unusually many cases enter or leave a segment."""
    return _hles(spark, sf_dir, ("enter", "exit")).select("hle_id", *VALUE, "class")


QUERIES["hle_enter_exit"] = enter_exit
sql.CTE["ee"] = sql.union("v", ("enter", "exit"))
sql.CTE["ee_limits"] = (sql.limits("ee", "type"), ("ee",))
ORACLES["hle_enter_exit"] = sql.query(f"SELECT hle_id, {', '.join(VALUE)}, class FROM ({sql.hles('ee', 'ee_limits', 'type')})", "ee", "ee_limits")
