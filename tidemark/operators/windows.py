"""Time windows: by unit or by number. The log's first and last time are read once, as two numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.units import UNIT_US, check_unit, unit_number


@dataclass(frozen=True)
class Frame:
    """How times become window numbers from 0 on, and windows borders in seconds."""

    width: str | int
    first: int
    last: int
    start: float
    size: float

    def number(self, us: Column) -> Column:
        if isinstance(self.width, str):
            return unit_number(us, self.width) - F.lit(self.first)
        at = F.floor((us / F.lit(1e6) - F.lit(self.start)) / F.lit(self.size)).cast("long")
        return F.least(at, F.lit(self.last))

    def right(self, w: Column) -> Column:
        return F.lit(self.start) + (w + 1) * F.lit(self.size)

    def left(self, w: Column) -> Column:
        return F.lit(self.start) + w * F.lit(self.size)

    def most(self) -> int:
        """The last window's number."""
        return self.last - self.first if isinstance(self.width, str) else self.last

    def borders(self, spark: SparkSession) -> DataFrame:
        count = self.last + 1 if not isinstance(self.width, str) else self.last - self.first + 1
        w = spark.range(count).select(F.col("id").alias("w"))
        return w.select("w", self.left(F.col("w")).alias("left_s"), self.right(F.col("w")).alias("right_s"))


def frame(log: DataFrame, width: str | int = "days", compat: str = "fixed") -> Frame:
    """A unit's name, or a number of windows.

    'fixed': a day's borders are that day's, and a number of windows gives as many. 'reference': days
    have the borders of the day before, and the last of the windows asked for is dropped, its events going
    to the one before (one window alone is an error there).
    """
    first, last = log.agg(F.min("us"), F.max("us")).first()
    if first is None:
        return Frame(width, 0, -1, 0.0, 1.0)
    if isinstance(width, str):
        check_unit(width)
        edge = math.floor if width == "days" else math.ceil
        unit = UNIT_US[width] / 1e6
        u0, u1 = edge(first / UNIT_US[width]), edge(last / UNIT_US[width])
        back = 0 if width == "days" and compat == "fixed" else 1
        return Frame(width, u0, u1, (u0 - back) * unit, unit)
    if width < 1:
        raise ValueError("the number of windows must be 1 or more")
    start, end = first / 1e6, last / 1e6
    size = float(max(1, math.ceil((end - start) / width)))
    count = max(1, math.ceil((end - start) / size))
    if compat == "reference":
        count -= 1
        if count < 1:
            raise ValueError("one window alone has no events there")
    return Frame(int(width), 0, count - 1, start, size)


def with_windows(log: DataFrame, f: Frame) -> DataFrame:
    return log.withColumn("w", f.number(F.col("us")))


def steps_with_windows(steps: DataFrame, f: Frame) -> DataFrame:
    return steps.withColumns({"w_i": f.number(F.col("us_i")), "w_j": f.number(F.col("us_j"))})
