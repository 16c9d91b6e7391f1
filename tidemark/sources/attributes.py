"""All attributes of XES logs as rows, at any depth: attributes of attributes, lists, containers, and the log's globals.

Spark deals files out in pieces that end with a trace; a parser inside of the tasks lists each piece's attributes as they
are written, so values keep their text (007 stays 007) and their order. A piece is a trace: no task holds more than one
at a time. Files are UTF-8; ``</trace>`` inside of a comment or CDATA section is an error of the parser.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("string", "date", "int", "float", "boolean", "id", "list", "container")
COLUMNS = "trace long, owner string, pos long, place array<int>, keys array<string>, kind string, value string, leaf boolean"
_ARROW = pa.schema([("trace", pa.int64()), ("owner", pa.string()), ("pos", pa.int64()), ("place", pa.list_(pa.int32())), ("keys", pa.list_(pa.string())), ("kind", pa.string()), ("value", pa.string()), ("leaf", pa.bool_())])
#: Attributes that a log's globals may declare; they are read on the driver.
MOST_DEFAULTS = 1_000
#: Rows of a batch that tasks give back.
BATCH = 8_192

Default = tuple[list[int], list[str], str, str | None, bool]


#: Places in a row as the parser makes it: COLUMNS without the trace.
_OWNER, _POS, _PLACE, _KEYS, _KIND, _VALUE, _LEAF = range(7)


@dataclass
class _Element:
    """An open element that owns attributes: the log, a scope of globals, a trace, an event, or an attribute."""

    row: list
    children: int = 0
    names: set[str] = field(default_factory=set)


def rows_of(piece: str, defaults: dict[str, list[Default]]) -> list[list]:
    """The attributes of a piece of a file, a row each, behind a row for each trace and event itself (without a kind).

    An element that holds nothing gives its row, but for an empty trace, which gives none. A missing attribute of a
    trace or event that has a default is put behind the others.
    """
    rows: list[list] = []
    opened: list[_Element] = []
    events = 0

    def own(owner: str, pos: int | None = None) -> _Element:
        rows.append([owner, pos, (), (), None, None, True])
        return _Element(rows[-1])

    def start(name: str, given: dict[str, str]) -> None:
        nonlocal events
        tag = name.rpartition(":")[2]
        if tag == "global":
            opened.append(own(f"global:{given.get('scope', 'event')}"))
        elif tag == "trace":
            events = 0
            opened.append(own("trace"))
        elif tag == "event":
            opened.append(own("event", events))
            events += 1
        elif not opened:
            opened.append(_Element(["log", None, (), (), None, None, True]))
        elif tag in KINDS:
            up, key = opened[-1], given.get("key", "")
            of = up.row
            row = [of[_OWNER], of[_POS], (*of[_PLACE], up.children), (*of[_KEYS], key), tag, given.get("value"), True]
            up.children += 1
            up.names.add(key)
            of[_LEAF] = False
            rows.append(row)
            opened.append(_Element(row))
        else:  # values of a list, extensions and classifiers: what they hold belongs to the element around
            opened.append(opened[-1])

    def end(name: str) -> None:
        closed = opened.pop()
        tag = name.rpartition(":")[2]
        if tag == "trace" and rows[-1] is closed.row:
            rows.pop()
        elif tag in ("trace", "event"):
            for place, keys, kind, value, leaf in defaults.get(tag, ()):
                if keys[0] not in closed.names:
                    closed.row[_LEAF] = False
                    rows.append([*closed.row[: _POS + 1], (closed.children + place[0], *place[1:]), tuple(keys), kind, value, leaf])

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    text = piece.lstrip("﻿ \t\r\n")
    if not text:
        return []
    first = "<log" in text
    parser.Parse(("" if first else "<log>") + text + ("" if text.rstrip().endswith("</log>") else "</trace>"))
    return rows


def _repeated(values: tuple, kind: pa.DataType) -> pa.Array:
    """Lists of which few differ: each of these is made once."""
    known: dict[tuple, int] = {}
    at = [known.setdefault(v, len(known)) for v in values]
    return pa.array(list(known), kind).take(pa.array(at, pa.int32()))


def _batch(traces: list[int], rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    made = [_repeated(c, t.type) if i in (_PLACE, _KEYS) else pa.array(c, t.type) for i, (c, t) in enumerate(zip(columns, list(_ARROW)[1:], strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(traces, pa.int64()), *made], schema=_ARROW)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="</trace>").select(F.monotonically_increasing_id().alias("trace"), "value")


def _listed(pieces: DataFrame, defaults: dict[str, list[Default]]) -> DataFrame:
    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        traces: list[int] = []
        ready: list[list] = []
        for part in parts:
            for trace, piece in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = rows_of(piece.as_py(), defaults)
                traces += [trace] * len(found)
                ready += found
                if len(ready) >= BATCH:
                    yield _batch(traces, ready)
                    traces, ready = [], []
        if ready:
            yield _batch(traces, ready)

    return pieces.mapInArrow(batches, COLUMNS)


def globals_of(spark: SparkSession, path: str) -> dict[str, list[Default]]:
    """By scope (trace, event): the attributes that globals declare, as (place, keys, kind, value, leaf).

    Files may declare different attributes; two values of one attribute, or more than MOST_DEFAULTS, are an error.
    """
    declared = _listed(_pieces(spark, path).filter(F.contains("value", F.lit("<global"))), {}).filter("owner like 'global:%' and kind is not null")
    found = declared.groupBy("owner", "place", "keys", "kind", "value", "leaf").agg(F.min("trace").alias("at")).orderBy("at", "place").limit(MOST_DEFAULTS + 1).collect()
    if len(found) > MOST_DEFAULTS:
        raise ValueError(f"globals declare more than {MOST_DEFAULTS} attributes")
    out: dict[str, list[Default]] = {}
    seen: dict[tuple, tuple] = {}
    for r in found:
        scope, name = r.owner.partition(":")[2], (r.owner, tuple(r.keys), tuple(r.place[1:]))
        if seen.setdefault(name, (r.kind, r.value)) != (r.kind, r.value):
            raise ValueError(f"files declare different defaults of {r.keys} for {scope}s")
        out.setdefault(scope, []).append((list(r.place), list(r.keys), r.kind, r.value, r.leaf))
    return out


def read_attributes(spark: SparkSession, path: str, defaults: bool = True) -> DataFrame:
    """One row an attribute: trace (numbered in the order of the file, with gaps), owner (log, global:trace, global:event,
    trace, event), pos (which event of its trace, else null), place and keys (which sibling, and of what key, at each
    level from the outermost), kind, value (null for lists and containers), leaf (nothing inside).

    Each trace and event has a row of its own too, without kind, so none is lost that has no attributes; empty traces are.
    With ``defaults``, which reads the files' headers first, attributes that a trace or event lacks come from the globals.
    """
    return _listed(_pieces(spark, path), globals_of(spark, path) if defaults else {})


def attribute_at(rows: DataFrame, *keys: str) -> DataFrame:
    """trace, pos, value of the attributes at these keys, from the outermost to the innermost."""
    return rows.filter(F.col("keys") == F.array(*[F.lit(k) for k in keys])).filter("owner in ('trace', 'event')").select("trace", "pos", "value")
