"""Time units. A day is the floor of days since the epoch; hours and minutes are rounded up, so an event
on an hour's border belongs to the hour that ends there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_US = {"days": 86_400_000_000, "hours": 3_600_000_000, "minutes": 60_000_000}


def check_unit(unit: str) -> str:
    if unit not in UNIT_US:
        raise ValueError(f"unknown unit {unit!r}; it is one of {', '.join(UNIT_US)}")
    return unit


def unit_number(us: Column, unit: str) -> Column:
    """Number of the unit that microseconds since the epoch fall into."""
    quotient = us / F.lit(UNIT_US[check_unit(unit)])
    return (F.floor(quotient) if unit == "days" else F.ceil(quotient)).cast("long")


def seconds(us: Column) -> Column:
    return us / F.lit(1_000_000.0)


def timestamp(seconds_: Column) -> Column:
    """Back from seconds, keeping microseconds."""
    return F.timestamp_micros(F.round(seconds_ * 1_000_000).cast("long"))
