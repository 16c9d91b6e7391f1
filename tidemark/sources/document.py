"""One XES document from a log or from rows of attributes, written in parallel.

A document is lines in order of trace and place. Lines are sorted by ranges, so a trace of any length runs over as many
tasks as it needs; each range is a part file, and header, parts and end are put together once all are written. File
systems that can concatenate (HDFS) do so without reading the parts.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import Staging

NAMESPACE = "http://www.xes-standard.org/"
#: Behind all places of siblings.
_LAST = 2**62
_CONCAT = "fs.capability.paths.concat"


@dataclass(frozen=True)
class Header:
    """What stands before the traces. Globals are (kind, key, value) by scope, attributes the log's own."""

    extensions: tuple[tuple[str, str], ...] = (("Concept", "concept"), ("Lifecycle", "lifecycle"), ("Organizational", "org"), ("Time", "time"))
    globals: dict[str, tuple[tuple[str, str, str], ...]] = field(default_factory=dict)
    classifiers: tuple[tuple[str, tuple[str, ...]], ...] = (("Activity", ("concept:name",)),)
    attributes: tuple[tuple[str, str, str], ...] = ()

    def text(self) -> str:
        attribute = lambda kind, key, value: f'<{kind} key="{_plain(key)}" value="{_plain(value)}"/>'
        out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<log xes.version="1.0" xes.features="nested-attributes" xmlns="{NAMESPACE}">']
        out += [f'<extension name="{_plain(n)}" prefix="{_plain(p)}" uri="{NAMESPACE}{_plain(p)}.xesext"/>' for n, p in self.extensions]
        out += [f'<global scope="{scope}">{"".join(attribute(*a) for a in self.globals[scope])}</global>' for scope in ("trace", "event") if self.globals.get(scope)]
        quoted = lambda keys: " ".join(f"'{k}'" if " " in k else k for k in keys)
        out += [f'<classifier name="{_plain(n)}" keys="{_plain(quoted(keys))}"/>' for n, keys in self.classifiers]
        return "\n".join([*out, *(attribute(*a) for a in self.attributes)]) + "\n"


#: Characters with a meaning in XML, white space that a parser would turn into blanks, and what is written for them.
_MARKS = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}
#: Characters that XML 1.0 cannot hold; they are left out.
_NONE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def _plain(text: str) -> str:
    return re.sub(_NONE, "", text).translate(str.maketrans(_MARKS))


#: What makes a value be looked at again: most hold none of these.
_ANY = "[&<>\"\\x00-\\x1F\\uFFFE\\uFFFF]"


def escaped(value: Column) -> Column:
    out = F.regexp_replace(value, _NONE, "")
    for mark, code in _MARKS.items():
        out = F.replace(out, F.lit(mark), F.lit(code))
    return F.when(value.rlike(_ANY), out).otherwise(value)


def _element(key: Column, value: Column, kind: T.DataType) -> Column:
    """A value of any type as an attribute: structs and maps are containers, arrays lists; empty if null."""
    named = F.concat(F.lit(' key="'), escaped(key), F.lit('"'))
    if isinstance(kind, T.StructType):
        inner = F.concat(F.lit(""), *[_element(F.lit(f.name), value[f.name], f.dataType) for f in kind])
        made = F.concat(F.lit("<container"), named, F.lit(">"), inner, F.lit("</container>"))
    elif isinstance(kind, T.MapType):
        inner = F.array_join(F.transform(F.map_entries(value), lambda e: _element(e["key"].cast("string"), e["value"], kind.valueType)), "")
        made = F.concat(F.lit("<container"), named, F.lit(">"), inner, F.lit("</container>"))
    elif isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(value, lambda x: _element(F.lit("item"), x, kind.elementType)), "")
        made = F.concat(F.lit("<list"), named, F.lit("><values>"), inner, F.lit("</values></list>"))
    else:
        tag, text = "string", escaped(value.cast("string"))
        if isinstance(kind, T.IntegralType):
            tag, text = "int", value.cast("string")
        elif isinstance(kind, (T.FractionalType, T.DecimalType)):
            tag, text = "float", value.cast("string")
        elif isinstance(kind, T.BooleanType):
            tag, text = "boolean", value.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            tag, text = "date", _time(value.cast("timestamp"))
        made = F.concat(F.lit(f"<{tag}"), named, F.lit(' value="'), text, F.lit('"/>'))
    return F.coalesce(F.when(value.isNotNull(), made), F.lit(""))


def _time(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def log_lines(log: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """(trace, place, line) of a log: a line an event, in order of time and position. ``extra`` names further columns of
    events by their keys, of any type. A trace is named by its case_name if the log has one, else by its case_id."""
    types = {f.name: f.dataType for f in log.schema}
    columns = {"act": "concept:name", "res": "org:resource", "lifecycle": "lifecycle:transition"} | (extra or {})
    inner = [_element(F.lit(key), F.col(c), types[c]) for c, key in columns.items() if c in types]
    when = _element(F.lit("time:timestamp"), F.timestamp_micros("us"), T.TimestampType())
    event = F.concat(F.lit("<event>"), *inner, when, F.lit("</event>"))
    events = log.select(F.col("case_id").alias("trace"), F.array(F.lit(1).cast("long"), F.col("us"), F.col("pos").cast("long")).alias("place"), event.alias("line"))
    name = F.min("case_name") if "case_name" in types else F.first("case_id")
    cases = log.groupBy(F.col("case_id").alias("trace")).agg(name.cast("string").alias("name"))
    ends = F.array(_line([], F.concat(F.lit("<trace>"), _element(F.lit("concept:name"), F.col("name"), T.StringType()))), _line([F.lit(2).cast("long")], F.lit("</trace>")))
    return events.unionByName(cases.select("trace", F.inline(ends)))


def _line(place: list[Column], line: Column) -> Column:
    where = F.array(*place) if place else F.array().cast("array<long>")
    return F.struct(where.alias("place"), line.alias("line"))


def attribute_lines(rows: DataFrame) -> DataFrame:
    """(trace, place, line) of rows of read_attributes(); those of the log and its globals belong to a Header."""
    in_event = F.col("owner") == "event"
    at = F.concat(F.when(in_event, F.array(F.lit(1).cast("long"), F.col("pos"))).otherwise(F.array(F.lit(0).cast("long"))), F.col("place").cast("array<long>"))
    own, kind = F.col("kind").isNull(), F.col("kind")
    first = F.when(own & ~in_event, F.array().cast("array<long>")).otherwise(at)
    last = F.when(own & ~in_event, F.array(F.lit(2).cast("long"))).otherwise(F.concat(at, F.array(F.lit(_LAST).cast("long"))))
    tag = F.coalesce(kind, F.col("owner"))
    value = F.when(F.col("value").isNotNull(), F.concat(F.lit(' value="'), escaped(F.col("value")), F.lit('"'))).otherwise("")
    given = F.when(own, "").otherwise(F.concat(F.lit(' key="'), escaped(F.element_at("keys", -1)), F.lit('"'), value))
    is_list = F.coalesce(kind == "list", F.lit(False))
    start = F.concat(F.lit("<"), tag, given, F.lit(">"), F.when(is_list, "<values>").otherwise(""))
    end = F.concat(F.when(is_list, "</values>").otherwise(""), F.lit("</"), tag, F.lit(">"))
    alone = F.array(F.struct(first.alias("place"), F.concat(start, end).alias("line")))
    around = F.array(F.struct(first.alias("place"), start.alias("line")), F.struct(last.alias("place"), end.alias("line")))
    inside = rows.filter("owner in ('trace', 'event')")
    return inside.select("trace", F.inline(F.when(F.col("leaf") & ~(own & ~in_event), alone).otherwise(around)))


def write_lines(lines: DataFrame, path: str, header: Header | None = None) -> None:
    """The document at ``path``, in place of what is there. Parts are written to a folder beside it, which goes in the end;
    a run that fails leaves the old document as it was.

    Only one writer can make a file where the file system cannot concatenate: there, local paths are joined by
    copying, and others are an error (write_xes() gives part files that are documents each).
    """
    spark = lines.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(parts)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    joins = files.hasPathCapability(where, _CONCAT)
    if not joins and files.getScheme() != "file":
        raise ValueError(f"{files.getScheme()} cannot concatenate files; write_xes() writes a folder")
    stage = Staging(spark, "lines")
    try:
        # ranges come from a sample of all lines: these are made once and read twice
        stage.table(lines, "lines").sort("trace", "place").select("line").write.option("compression", "none").text(parts)
        _put_together(spark, files, parts, path, (header or Header()).text(), joins)
    finally:
        files.delete(where, True)
        stage.drop()


def _put_together(spark: SparkSession, files, parts: str, path: str, header: str, joins: bool) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in files.listStatus(at(parts)) if s.getLen()]
    ranges = sorted((int(m[1]), n) for n in names if (m := re.match(r"part-(\d+)", n)))

    def small(name: str, text: str):
        out = files.create(at(f"{parts}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
        return at(f"{parts}/{name}")

    whole, end = small("_document", header), small("_end", "</log>\n")
    pieces = [at(f"{parts}/{n}") for _, n in ranges] + [end]
    if joins:
        array = spark.sparkContext._gateway.new_array(at, len(pieces))
        for i, p in enumerate(pieces):
            array[i] = p
        files.concat(whole, array)
    else:
        out = files.create(whole, True)
        out.write(bytearray(header.encode()))
        for p in pieces:
            source = files.open(p)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
        out.close()
    files.delete(at(path), True)
    files.rename(whole, at(path))


def write_document(log: DataFrame, path: str, extra: dict[str, str] | None = None, header: Header | None = None) -> None:
    """A log as one document."""
    write_lines(log_lines(log, extra), path, header)
