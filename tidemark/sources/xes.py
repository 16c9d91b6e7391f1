"""XES event logs with Spark's XML source. Typed attributes are children named by type, each with key and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .attributes import globals_of

_ATTRIBUTE = "array<struct<_key:string,_value:string>>"
_KINDS = ("string", "date", "int", "float", "boolean")
_CHILDREN = ",".join(f"{k}:{_ATTRIBUTE}" for k in _KINDS)
SCHEMA = f"{', '.join(f'{k} {_ATTRIBUTE}' for k in _KINDS)}, event array<struct<{_CHILDREN}>>"


def attribute(owner: str | None, kind: str, key: str) -> Column:
    """Value of the first attribute of that type and key, or null."""
    field = F.col(f"{owner}.{kind}" if owner else kind)
    return F.get(F.filter(field, lambda a: a["_key"] == key), F.lit(0))["_value"]


#: An empty trace, and where any other one starts.
_EMPTY, _START = r"<trace(\s[^<>]*)?/>", r"<trace[\s>]"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """One row a trace that is not empty, numbered in the order of the file: trace, its attributes and events.

    Files are dealt out in pieces that end with a trace, as in attributes.py, so a large document is many tasks' work; Spark's
    XML parser reads each piece. A piece that is no XML is an error.
    """
    pieces = spark.read.text(path, lineSep="</trace>").select(F.monotonically_increasing_id().alias("trace"), F.col("value").alias("piece"))
    bare = F.when(F.contains("piece", F.lit("<!--")), F.regexp_replace("piece", "(?s)<!--.*?-->", "")).otherwise(F.col("piece"))
    full = F.when(bare.rlike(_EMPTY), F.regexp_replace(bare, _EMPTY, "")).otherwise(bare)
    started = pieces.withColumn("piece", full).withColumn("at", F.regexp_instr("piece", F.lit(_START)))
    # what is behind the last trace is null, and never parsed, in whatever order filters run
    text = F.when(F.col("at") > 0, F.concat(F.expr("substring(piece, at)"), F.lit("</trace>")))
    parsed = F.from_xml(text, SCHEMA, {"mode": "FAILFAST"})
    # as rows of an array of one, a piece is parsed once, however many of its columns are asked for
    return started.filter("at > 0").select("trace", F.inline(F.array(parsed)))


def read_xes(spark: SparkSession, path: str, trace_attributes: dict[str, tuple[str, str]] | None = None, defaults: bool = False) -> DataFrame:
    """A log: case_id is the trace's number in the order of the file (gapped), as traces may share a name or have none;
    case_name is its concept:name. ``pos`` counts all of the trace's events; those without an activity or a readable
    time are left out.

    ``trace_attributes`` names further columns by (type, key), such as {"amount": ("float", "RequestedAmount")}. With
    ``defaults``, attributes that a trace or event lacks have the value that the log's globals declare. Nested attributes
    are read by attributes.read_attributes().
    """
    declared = globals_of(spark, path) if defaults else {}
    known = {(scope, kind, keys[0]): value for scope, found in declared.items() for _, keys, kind, value, _ in found if len(keys) == 1}

    def of(owner: str | None, kind: str, key: str) -> Column:
        value = known.get(("event" if owner else "trace", kind, key))
        return attribute(owner, kind, key) if value is None else F.coalesce(attribute(owner, kind, key), F.lit(value))

    extra = {n: of(None, k, key) for n, (k, key) in (trace_attributes or {}).items()}
    traces = read_traces(spark, path)
    # attributes of the trace are read before its events are: an explode in the same step would number events
    traces = traces.withColumn("case_name", of(None, "string", "concept:name")).withColumns(extra)
    events = traces.select("case_name", F.col("trace").alias("case_id"), *extra, F.posexplode("event").alias("pos", "e"))
    return events.select(
        "case_id",
        F.col("pos").cast("long").alias("pos"),
        of("e", "string", "concept:name").alias("act"),
        of("e", "string", "org:resource").alias("res"),
        F.unix_micros(F.try_to_timestamp(of("e", "date", "time:timestamp"))).alias("us"),
        of("e", "string", "lifecycle:transition").alias("lifecycle"),
        "case_name",
        *extra,
    ).filter("act is not null and us is not null")


def to_traces(log: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """A log nested as XES traces: (string, event), events in order of time and position. A trace is named by its
    case_name if the log has one, else by its case_id."""
    def pair(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value"))

    strings = [pair("concept:name", F.col("act"))] + [pair(k, F.col(c)) for c, k in (extra or {}).items()]
    if "res" in log.columns:
        strings.append(pair("org:resource", F.col("res")))
    when = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    event = F.struct(F.filter(F.array(*strings), lambda a: a["_value"].isNotNull()).alias("string"), F.array(pair("time:timestamp", when)).alias("date"))
    name = F.first("case_name") if "case_name" in log.columns else F.first("case_id")
    nested = log.groupBy("case_id").agg(name.alias("name"), F.sort_array(F.collect_list(F.struct("us", "pos", event.alias("e")))).alias("es"))
    return nested.select(F.filter(F.array(pair("concept:name", F.col("name"))), lambda a: a["_value"].isNotNull()).alias("string"), F.transform("es", lambda x: x["e"]).alias("event"))


def write_xes(log: DataFrame, path: str, extra: dict[str, str] | None = None) -> None:
    """Part files under ``path``, each a complete log; read_xes() reads the folder."""
    to_traces(log, extra).write.mode("overwrite").format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)


def trace_order(log: DataFrame) -> DataFrame:
    """Dense numbers of the traces in file order, where gapped ones will not do: numbers within each part of the
    file, plus the cases of the parts before it. Only the parts' counts, one row each, meet in one task."""
    cases = log.select("case_id").distinct().withColumn("_part", F.shiftright("case_id", 33))
    counts = cases.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("case_id")) - 1
    return cases.withColumn("_i", inside).join(counts.select("_part", before.alias("_before")), "_part").select("case_id", (F.col("_before") + F.col("_i")).alias("number"))
