"""Event logs as tables: case_id, pos (order within the case), act, res, us (microseconds since the epoch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_table(df: DataFrame, case: Column, act: Column, us: Column, order: list[Column], res: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """A log from any table; ``order`` places events within their case. Rows without case, activity or time go."""
    cols = {"case_id": case, "act": act, "res": F.lit(None).cast("string") if res is None else res, "us": us} | (extra or {})
    keyed = df.select(*[c.alias(n) for n, c in cols.items()], *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    place = Window.partitionBy("case_id").orderBy(*[f"_o{i}" for i in range(len(order))])
    return keyed.filter("case_id is not null and act is not null and us is not null").withColumn("pos", (F.row_number().over(place) - 1).cast("long")).select("case_id", "pos", *list(cols)[1:])


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_events(spark: SparkSession, sf_dir: str, clock: str | None = None) -> DataFrame:
    """The table ``events``: users are cases, event types activities, and k modulo 8 names the resource. With
    a ``clock`` ('day', 'hour', ...) times are cut to it, so that events of a case tie."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("int")
    return from_table(df, F.col("user_id"), F.col("event_type"), F.unix_micros(F.date_trunc(clock, ts) if clock else ts), [F.col("ts"), F.col("event_id")], F.concat(F.lit("R"), (k % 8).cast("string")), {"value": F.col("value")})


def event_table(log: DataFrame, with_resource: bool = True) -> DataFrame:
    """Events with ``single``, whether the event is alone in its case; with or without resources."""
    out = log.withColumn("single", F.count("*").over(Window.partitionBy("case_id")) == 1)
    cols = ["case_id", "pos", "act", *(["res"] if with_resource else []), "us", "single"]
    return out.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays and structs are written as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, written by ``make()`` first if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
