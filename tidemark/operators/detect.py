"""High-level events: values beyond percentile thresholds of their feature's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import Staging

from .features import ENTITY, KEYS
from .ranks import percentiles

DELAY_SHARE, DELAY_LEAST = 0.7, 10
#: Thresholds where there are no values but zeros: nothing is above, nothing is below.
NO_HIGH, NO_LOW = 1e10, 0.0


def share(p: float) -> float:
    if not 0 < p <= 1:
        raise ValueError("p is a share above 0, at most 1")
    return p


def group_of(by: str) -> list[str]:
    if by not in ("type", "entity"):
        raise ValueError("thresholds are by 'type' or by 'entity'")
    return ["f_type", "comp_type"] if by == "type" else ENTITY


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join by null-safe keys, as only segments have e2."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, on, "left").drop(*[f"_{k}" for k in keys])


def thresholds(values: DataFrame, p: float, by: str = "type") -> DataFrame:
    """low, high and, of delays, the least bundle above which one counts; by feature and type, or by entity.

    Zeros are left out. Delays always use the share 0.7; their bundle threshold is the share ``p`` of the
    sizes of bundles beyond it. Percentiles are exact and found by ranks, so a type may have any number of values.
    """
    share(p)
    keys = group_of(by)
    stage = Staging(values.sparkSession, "thresholds")
    # values and sizes of bundles with their numbers, few beside the values, are all that is read on
    delay = F.col("f_type") == "delay"
    counts = stage.table(values.filter(~delay | (F.col("n") > 0)).groupBy(*keys, "value", F.when(delay, F.col("n")).alias("size")).agg(F.count("*").alias("n")), "counts")
    low = lambda q: round((100 - q * 100) / 100, 9)
    shares = {"low": low(p), "high": p, "delay_low": low(DELAY_SHARE), "delay_high": DELAY_SHARE}
    found = percentiles(counts.withColumn("value", F.nullif("value", F.lit(0.0))), keys, "value", shares, Staging(values.sparkSession, "values"), "n")
    # Values have 6 places and percentiles lie between two of them at a short fraction: at 9 places no engine rounds another way.
    edge = lambda c, none: F.coalesce(F.round(F.when(delay, F.col(f"delay_{c}")).otherwise(F.col(c)), 9), F.lit(none)).alias(c)
    edges = _with(counts.select(*keys).distinct(), found, keys).select(*keys, edge("low", NO_LOW), edge("high", NO_HIGH))
    delays = counts.filter(delay)
    if delays.isEmpty():
        return edges.withColumn("bundle", F.lit(None).cast("double"))
    edges = stage.table(edges, "edges")
    sizes = _with(delays, edges.select(*keys, "high"), keys).filter("value > high and size <> 0")
    bundles = percentiles(sizes, keys, "size", {"bundle": p}, Staging(values.sparkSession, "bundles"), "n")
    both = _with(edges, bundles, keys)
    return both.select(*keys, "low", "high", F.when(delay, F.coalesce(F.round("bundle", 9), F.lit(NO_HIGH))).alias("bundle"))


def class_of(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "Low").when(value > high, "High").otherwise("Normal")


def hle_id() -> Column:
    """An id that its content gives: equal in every run, ordered by window, and another one for other names, whatever
    marks these hold: backslashes and bars in them get a backslash."""
    pad = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws("|", pad("w1"), pad("w2"), "f_type", "comp_type", safe("e1"), safe("e2"), "class")


def detect(values: DataFrame, limits: DataFrame, traffic: tuple[str, ...] = ("High",), by: str = "type", delay_least: int = DELAY_LEAST) -> DataFrame:
    """High-level events among the values; delays count if their bundle is large enough: beyond the bundle
    threshold by type, of ``delay_least`` steps by entity. Values of 0 have no row and are no event: see low_zeros()."""
    keys = group_of(by)
    joined = values.alias("v").join(limits.alias("t"), [F.col(f"v.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    found = joined.select("v.*", "low", "high", "bundle").withColumn("class", class_of(F.col("value"), F.col("low"), F.col("high")))
    enough = F.col("n") > F.col("bundle") if by == "type" else F.col("n") >= delay_least
    found = found.filter(F.col("class").isin(list(traffic)) & ((F.col("f_type") != "delay") | enough))
    return found.drop("low", "high", "bundle").withColumn("hle_id", hle_id())


def low_zeros(values: DataFrame, limits: DataFrame, windows: DataFrame) -> DataFrame:
    """The events that zeros are: entities without a value in a window, where the low threshold is above 0.

    Only single windows of features by type; the grid of entities and windows is made for those features alone.
    """
    need = limits.filter("low > 0").select("f_type", "comp_type")
    entities = values.filter("w1 = w2").select(*ENTITY).distinct().join(need, ["f_type", "comp_type"], "left_semi")
    last = windows.agg(F.max("w")).first()[0]
    grid = entities.withColumn("w1", F.explode(F.sequence(F.lit(0), F.lit(last)))) if last is not None else entities.withColumn("w1", F.lit(0)).limit(0)
    there = values.select(*KEYS[:-1])
    on = [F.col(f"g.{k}").eqNullSafe(F.col(f"v.{k}")) for k in KEYS[:-1]]
    none = grid.alias("g").join(there.alias("v"), on, "left_anti")
    return none.select(*ENTITY, F.col("w1").cast("long").alias("w1"), F.col("w1").cast("long").alias("w2"), F.lit(0.0).alias("value"), F.lit("Low").alias("class")).withColumn("hle_id", hle_id())


def case_rows(hles: DataFrame, rows: DataFrame) -> DataFrame:
    """(hle_id, case_id) of the cases of each event, once each; only instances of high-level events are looked at."""
    named = hles.select("hle_id", *[F.col(k).alias(f"_{k}") for k in KEYS])
    on = F.lit(True)
    for k in KEYS:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.select(*KEYS, "case_id").join(named, on).select("hle_id", "case_id").distinct()


def case_sets(hles: DataFrame, rows: DataFrame) -> DataFrame:
    """hle_id and its distinct cases, sorted: a listing. Operators take the rows of case_rows()."""
    return case_rows(hles, rows).groupBy("hle_id").agg(F.sort_array(F.collect_list("case_id")).alias("cases"))


def hla_counts(hles: DataFrame) -> DataFrame:
    """High-level activities (feature, entity, class) and how often each occurs."""
    return hles.groupBy(*ENTITY, "class").agg(F.count("*").alias("frequency"))


def filter_hla(hles: DataFrame, frequency: float, compat: str = "fixed") -> DataFrame:
    """High-level activities that are frequent: by a percentile of the counts (0 < f < 1), or the f most
    frequent (f of 1 or more; the reference takes the least frequent, and 1 as no filter); else all."""
    counts = hla_counts(hles)
    if 0 < frequency < 1:
        least = percentiles(counts, [], "frequency", {"least": frequency}).first()
        return counts.filter(F.col("frequency") >= F.lit(least[0] if least and least[0] is not None else 0.0))
    if frequency > 1 or frequency == 1 and compat == "fixed":
        order = F.col("frequency") if compat == "reference" else F.col("frequency").desc()
        return counts.orderBy(order, *ENTITY, "class").limit(int(frequency))
    return counts
