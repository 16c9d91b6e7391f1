"""Ranks and percentiles by group over many tasks: distinct values with their counts are dealt out by ranges, and ranges
are joined by the counts of those before them. No task holds a group's values, however many it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import Staging


def ranked(counts: DataFrame, keys: list[str], order: list[str], n: str | None = None, stage: Staging | None = None) -> DataFrame:
    """Adds ``before``: how many rows of the same keys come first in the order, where each row stands for ``n`` rows (or one).

    Rows are sorted into ranges of keys and order, and written with their range's number: sampled borders may differ
    from run to run, written ones do not. Sums run inside of a range; sums over ranges have a row a range and key.
    """
    stage = stage or Staging(counts.sparkSession, "ranks")
    weight = F.lit(1).cast("long") if n is None else F.col(n).cast("long")
    placed = stage.table(counts.withColumn("_n", weight).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    here, among = Window.partitionBy("_range", *keys), Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_at")
    inside = F.sum("_n").over(here.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = placed.groupBy(F.col("_range").alias("_at"), *[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("_n").alias("_sum"))
    earlier = totals.withColumn("_earlier", F.sum("_sum").over(among.rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    on = (F.col("_range") == F.col("_at")) & _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    out = placed.withColumn("_inside", inside).join(earlier, on)
    zero = F.lit(0).cast("long")
    return out.select(*counts.columns, (F.coalesce("_inside", zero) + F.coalesce("_earlier", zero)).alias("before"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def percentiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float], stage: Staging | None = None, n: str | None = None) -> DataFrame:
    """Keys and, for each name in ``shares``, the exact percentile of the keys' values, between two of them in proportion.

    Nulls do not count, and keys without values have no row. A row stands for ``n`` values, or one.
    """
    times = F.count("*") if n is None else F.sum(n)
    counts = values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(times.alias("_c"))
    places = ranked(counts, keys, ["_v"], "_c", stage)
    sizes = places.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("_c").alias("_size"))
    sized = places.join(sizes, _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    picked, out = [], []
    for i, (name, share) in enumerate(shares.items()):
        at = F.lit(float(share)) * (F.col("_size") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("_c"))
        picked += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_low{i}"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_high{i}"), F.max(at).alias(f"_at{i}")]
        a, b, p = F.col(f"_low{i}"), F.col(f"_high{i}"), F.col(f"_at{i}")
        out.append(F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b).alias(name))
    return sized.groupBy(*keys).agg(*picked).select(*keys, *out)
