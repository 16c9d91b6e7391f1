"""Features of activities, resources and segments by window: instances, and their values.

An instance row says which case counts for which feature, entity and window (or pair of windows). Only
windows that occur are produced; a missing row stands for the value 0.

Features of spans (SPANS) count what is open from a step's window up to its next one's. Their values come from changes: a
row where a span begins and one where it ends, summed by entity and window; running sums, made within blocks of
windows and carried from block to block, give what is open in each. So a span costs two rows however many windows it
covers, and an entity's windows are many tasks' work.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import Staging

from .steps import finals
from .windows import Frame

#: In the order in which high-level events are listed.
FEATURES = ("exec", "to-exec", "do", "todo", "busy", "enter", "exit", "cross", "wt", "handover", "workload", "batch", "delay")
LOG_FEATURES = FEATURES[:11]
PATH_FEATURES = ("exit", "enter", "handover", "workload", "batch", "delay")
SPANS = ("to-exec", "todo", "busy", "cross", "wt")
ENTITY = ["f_type", "comp_type", "e1", "e2"]
#: Windows of a block of running sums.
BLOCK = 1024
#: Of a second. Times in seconds, as doubles, are whole numbers of these from 1972 on: sums are exact, and equal those of doubles.
TICKS = float(1 << 26)
KEYS = [*ENTITY, "w1", "w2"]


@dataclass(frozen=True)
class Scope:
    """Which entities are looked at: activities and the segments among them, resources, and frequent segments. None is
    all of them. Events and steps stay as they are, so the values of what is left do not change."""

    activities: tuple[str, ...] | None = None
    resources: tuple[str, ...] | None = None
    segments: DataFrame | None = None

    def of(self, rows: DataFrame, f_type: str) -> DataFrame:
        if f_type in ("exec", "to-exec"):
            return rows if self.activities is None else rows.filter(F.col("e1").isin(list(self.activities)))
        if f_type in ("do", "todo", "busy"):
            return rows if self.resources is None else rows.filter(F.col("e1").isin(list(self.resources)))
        if self.activities is not None:
            rows = rows.filter(F.col("e1").isin(list(self.activities)) & F.col("e2").isin(list(self.activities)))
        if self.segments is not None:
            rows = rows.join(self.segments.select(F.col("a_i").alias("e1"), F.col("a_j").alias("e2")), ["e1", "e2"], "left_semi").select(rows.columns)
        return rows


ALL = Scope()


def instances(f_type: str, log: DataFrame, steps: DataFrame, f: Frame, compat: str = "fixed") -> DataFrame:
    """Rows (keys, case_id, w_i, w_j, r_i, r_j, wait) of one feature; log and steps have window numbers.

    Where times tie, 'fixed' counts an event once, 'reference' once for each of its steps; the latter also
    gives every activity that is ever run the log's first event in each window of to-exec.
    """
    null = F.lit(None).cast("string")

    def rows(df: DataFrame, comp: str, e1: Column, e2: Column, w1: Column, w2: Column | None = None) -> DataFrame:
        has = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
        return df.select(F.lit(f_type).alias("f_type"), F.lit(comp).alias("comp_type"), e1.alias("e1"), e2.alias("e2"), w1.cast("long").alias("w1"), (w1 if w2 is None else w2).cast("long").alias("w2"), "case_id", has("w_i", "long").alias("w_i"), has("w_j", "long").alias("w_j"), has("r_i", "string").alias("r_i"), has("r_j", "string").alias("r_j"), has("wait", "double").alias("wait"))

    w, w_i, w_j = F.col("w"), F.col("w_i"), F.col("w_j")
    seg = lambda df, w1, w2=None: rows(df, "segment", F.col("a_i"), F.col("a_j"), w1, w2)

    def done(comp: str, event: str, step: str) -> DataFrame:
        """Each event at its own window."""
        if compat == "fixed":
            return rows(log, comp, F.col(event), null, w)
        return rows(steps, comp, F.col(step), null, w_i).unionByName(rows(finals(log, steps), comp, F.col(event), null, w))

    def waiting(comp: str, name: str) -> DataFrame:
        """Each event to come, at the windows from the one before it up to its own."""
        open_ = steps.filter("w_i < w_j")
        if compat == "fixed":
            open_ = open_.groupBy("case_id", "pos_j", "a_j", "r_j", "w_j").agg(F.min("w_i").alias("w_i"))
        spread = open_.withColumn("w", F.explode(F.sequence("w_i", F.col("w_j") - 1)))
        return rows(spread, comp, F.col(name), null, w)

    if f_type == "exec":
        return done("activity", "act", "a_i")
    if f_type == "to-exec":
        out = done("activity", "act", "a_i").unionByName(waiting("activity", "a_j"))
        if compat == "reference":
            first = log.orderBy("case_id", "pos").select("case_id").first()
            if first is not None:
                spans = log.select("act").distinct().withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(f.most())))).withColumn("case_id", F.lit(first[0]))
                out = out.unionByName(rows(spans, "activity", F.col("act"), null, w))
        return out
    if f_type == "do":
        return done("resource", "res", "r_i").filter("e1 is not null")
    if f_type == "todo":
        return waiting("resource", "r_j").filter("e1 is not null")
    if f_type == "busy":
        return done("resource", "res", "r_i").unionByName(waiting("resource", "r_j")).filter("e1 is not null")
    if f_type == "enter":
        return seg(steps, w_i)
    if f_type == "exit":
        return seg(steps, w_j)
    if f_type in ("cross", "wt"):
        spread = steps.withColumn("w", F.explode(F.sequence("w_i", "w_j")))
        if f_type == "wt":
            until = F.when(w == w_j, F.col("us_j") / 1e6).otherwise(f.right(w))
            spread = spread.withColumn("wait", until - F.col("us_i") / 1e6)
        return seg(spread, w)
    if f_type == "handover":
        return seg(steps.filter("r_i <> r_j"), w_j)
    if f_type == "workload":
        return seg(steps.filter("r_i = r_j"), w_j)
    if f_type in ("batch", "delay"):
        return seg(steps.filter("w_i < w_j"), w_i, w_j)
    raise ValueError(f"unknown feature {f_type!r}; they are {', '.join(FEATURES)}")


def _value(f_type: str) -> Column:
    n = F.count("*")
    if f_type == "wt":
        return F.avg("wait")
    if f_type == "handover":
        return F.count_distinct("r_i") / F.count_distinct("r_j")
    if f_type == "workload":
        return n / F.count_distinct("r_i")
    if f_type == "delay":
        return F.max(F.col("w2") - F.col("w1"))
    return n


def evaluate(rows: DataFrame, f_type: str) -> DataFrame:
    """Value, number of instances and window spans by key; values are rounded to 6 places, so that thresholds
    compare alike however sums were ordered. A delay's value is its distance in windows."""
    return rows.groupBy(*KEYS).agg(F.round(_value(f_type).cast("double"), 6).alias("value"), F.count("*").alias("n"), F.min("w_i").alias("w_i_min"), F.max("w_i").alias("w_i_max"), F.min("w_j").alias("w_j_min"), F.max("w_j").alias("w_j_max"))


def changes(f_type: str, log: DataFrame, steps: DataFrame, f: Frame, compat: str = "fixed") -> DataFrame:
    """Of a feature of spans: rows (entity, w, opened, since, hits, waited): how many spans open at w less those that close,
    the sum of their starting times likewise, events that count at w alone, and how long these have waited, in ticks."""
    null, zero = F.lit(None).cast("string"), F.lit(0).cast("long")

    def change(w: Column, opened: int, since: Column = zero, hits: int = 0, waited: Column = zero) -> Column:
        return F.struct(w.cast("long").alias("w"), F.lit(opened).cast("long").alias("opened"), since.alias("since"), F.lit(hits).cast("long").alias("hits"), waited.alias("waited"))

    def rows(df: DataFrame, comp: str, e1: Column, e2: Column, found: Column) -> DataFrame:
        return df.select(F.lit(f_type).alias("f_type"), F.lit(comp).alias("comp_type"), e1.alias("e1"), e2.alias("e2"), F.explode(found).alias("c")).select(*ENTITY, "c.*")

    w_i, w_j = F.col("w_i"), F.col("w_j")
    if f_type in ("cross", "wt"):
        began, ended = F.col("us_i") / 1e6, F.col("us_j") / 1e6
        since, waited = (began * TICKS).cast("long"), ((ended - began) * TICKS).cast("long")
        end = change(w_j, 0, hits=1, waited=waited)
        both = F.array(change(w_i, 1, since), change(w_j, -1, -since, 1, waited))
        return rows(steps, "segment", F.col("a_i"), F.col("a_j"), F.when(w_i < w_j, both).otherwise(F.array(end)))
    comp, event, first, later = ("activity", "act", "a_i", "a_j") if f_type == "to-exec" else ("resource", "res", "r_i", "r_j")
    open_ = steps.filter("w_i < w_j")
    if compat == "fixed":
        open_ = open_.groupBy("case_id", "pos_j", later, "w_j").agg(F.min("w_i").alias("w_i"))
    out = rows(open_, comp, F.col(later), null, F.array(change(w_i, 1), change(w_j, -1)))
    if f_type != "todo":
        if compat == "fixed":
            out = out.unionByName(rows(log, comp, F.col(event), null, F.array(change(F.col("w"), 0, hits=1))))
        else:
            out = out.unionByName(rows(steps, comp, F.col(first), null, F.array(change(w_i, 0, hits=1))))
            out = out.unionByName(rows(finals(log, steps), comp, F.col(event), null, F.array(change(F.col("w"), 0, hits=1))))
    if f_type == "to-exec" and compat == "reference":
        whole = F.array(change(F.lit(0), 1), change(F.lit(f.most() + 1), -1))
        out = out.unionByName(rows(log.select("act").distinct(), comp, F.col("act"), null, whole))
    return out.filter("e1 is not null")


def open_runs(changed: DataFrame, stage: Staging, block: int = BLOCK) -> DataFrame:
    """Runs of windows (entity, first, last, open, since) in which nothing changes, with hits and waited of the first one.

    Changes are summed by entity and window and written once. Running sums stay within a block of windows of an
    entity; what earlier blocks leave open is carried in. Runs are cut at borders of blocks; a block's first row also gives the run
    before it, and its last one the run over the blocks without changes that follow.
    """
    at = changed.withColumn("since", F.col("since").cast("decimal(19,0)")).groupBy(*ENTITY, "w").agg(*[F.sum(c).alias(c) for c in ("opened", "since", "hits", "waited")])
    at = stage.table(at.withColumn("block", F.floor(F.col("w") / block)), "changes")
    # one row a block and entity: what those before it left open, and the next block
    order = Window.partitionBy(*ENTITY).orderBy("block")
    totals = at.groupBy(*ENTITY, "block").agg(F.sum("opened").alias("o"), F.sum("since").alias("s"))
    carried = [F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name) for c, name in (("o", "open_in"), ("s", "since_in"))]
    carry = totals.select(*[F.col(k).alias(f"_{k}") for k in [*ENTITY, "block"]], *carried, F.lead("block").over(order).alias("next"))
    on = F.lit(True)
    for k in [*ENTITY, "block"]:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*ENTITY, "block").orderBy("w")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = at.select(*ENTITY, "block", "w", "hits", "waited", F.lag("w").over(inside).alias("before"), F.lead("w").over(inside).alias("after"), F.sum("opened").over(upto).alias("o"), F.sum("since").over(upto).alias("s"))
    open_, since = F.col("o") + F.col("open_in"), (F.col("s") + F.col("since_in")).cast("decimal(38,0)")
    start, end, zero = F.col("block") * block, (F.col("block") + 1) * block, F.lit(0).cast("long")
    run = lambda first, last, o, s, hits, waited: F.struct(first.alias("first"), last.alias("last"), o.alias("open"), s.cast("decimal(38,0)").alias("since"), hits.alias("hits"), waited.alias("waited"))
    none = F.lit(None)
    runs = F.array(
        run(F.col("w"), F.coalesce(F.col("after") - 1, end - 1), open_, since, F.col("hits"), F.col("waited")),
        F.when(F.col("before").isNull() & (F.col("w") > start), run(start, F.col("w") - 1, F.col("open_in"), F.col("since_in"), zero, zero)).otherwise(none),
        F.when(F.col("after").isNull() & (F.col("next") * block > end), run(end, F.col("next") * block - 1, open_, since, zero, zero)).otherwise(none),
    )
    found = here.join(carry, on).select(*ENTITY, F.explode(F.filter(runs, lambda r: (r["open"] > 0) | (r["hits"] > 0))).alias("r"))
    return found.select(*ENTITY, "r.*")


def span_values(changed: DataFrame, f: Frame) -> DataFrame:
    """What evaluate() gives of features of spans, window by window; spans' own windows are not kept."""
    runs = open_runs(changed, Staging(changed.sparkSession, "spans"))
    each = runs.withColumn("w", F.explode(F.when(F.col("open") > 0, F.sequence("first", "last")).otherwise(F.array("first"))))
    here = F.col("w") == F.col("first")
    n = F.col("open") + F.when(here, F.col("hits")).otherwise(0)
    total = (f.right(F.col("w")) * TICKS).cast("decimal(19,0)") * F.col("open") - F.col("since") + F.when(here, F.col("waited")).otherwise(0)
    value = F.when(F.col("f_type") == "wt", total.cast("double") / F.lit(TICKS) / n).otherwise(n.cast("double"))
    none = [F.lit(None).cast("long").alias(c) for c in ("w_i_min", "w_i_max", "w_j_min", "w_j_max")]
    return each.filter(n > 0).select(*ENTITY, F.col("w").alias("w1"), F.col("w").alias("w2"), F.round(value, 6).alias("value"), n.alias("n"), *none)


def values(features: tuple[str, ...], log: DataFrame, steps: DataFrame, f: Frame, compat: str = "fixed", scope: Scope = ALL) -> DataFrame:
    """Values of the chosen features alone: others' branches are not in the plan. Changes of all features of spans are written as one table."""
    out = [evaluate(scope.of(instances(x, log, steps, f, compat), x), x) for x in features if x not in SPANS]
    spans = [scope.of(changes(x, log, steps, f, compat), x) for x in features if x in SPANS]
    if spans:
        out.append(span_values(reduce(DataFrame.unionByName, spans), f))
    return reduce(DataFrame.unionByName, out)


def all_instances(features: tuple[str, ...], log: DataFrame, steps: DataFrame, f: Frame, compat: str = "fixed", scope: Scope = ALL) -> DataFrame:
    return reduce(DataFrame.unionByName, [scope.of(instances(x, log, steps, f, compat), x) for x in features])
