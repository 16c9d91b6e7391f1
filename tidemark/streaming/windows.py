"""Entries into activities by tumbling windows of a stream, with a watermark for late events.

An extension of the batch features for live logs: counts of events by activity, and of steps by segment,
where a step needs the case's previous activity, which streaming state keeps for each case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEP = "case_id string, a_i string, a_j string, ts_i timestamp, ts_j timestamp"


def activity_counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, act, n) of a stream with act and ts; a window is final once the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "act").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "act", "n")


def _steps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    for frame in frames:
        rows = []
        for ts, act in frame.sort_values("ts")[["ts", "act"]].itertuples(index=False):
            if last is not None:
                rows.append((str(key[0]), last[0], act, last[1], ts))
            last = (act, ts)
        yield pd.DataFrame(rows, columns=["case_id", "a_i", "a_j", "ts_i", "ts_j"])
    if last is not None:
        state.update(last)


def stream_steps(stream: DataFrame) -> DataFrame:
    """Steps as their second event arrives. State holds one event a case; batches are taken to come in order."""
    return stream.groupBy("case_id").applyInPandasWithState(_steps, STEP, "act string, ts timestamp", "append", GroupStateTimeout.NoTimeout)
