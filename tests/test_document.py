"""Nested XES attributes as rows, and one document from parallel parts."""

import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tidemark.sources import attributes, document, xes

NESTED = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a log <with marks> -->
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
  <extension name="Concept" prefix="concept" uri="http://www.xes-standard.org/concept.xesext"/>
  <global scope="trace"><string key="team" value="none"/></global>
  <global scope="event"><string key="org:resource" value="nobody"><int key="grade" value="0"/></string></global>
  <string key="creator" value="somebody"/>
  <trace>
    <string key="concept:name" value="001"><int key="a &quot;b&quot; &amp; &lt;c&gt;" value="007"><boolean key="deep" value="true"/></int></string>
    <list key="parts"><values><string key="part" value="x"/><float key="part" value="1.50"/><string key="part" value="y&#10;z"/></values></list>
    <event>
      <string key="concept:name" value="open"/>
      <container key="cost"><float key="total" value="12.0"/><list key="drivers"><values><string key="driver" value="d1"><date key="since" value="2019-05-06T08:15:00.000+02:00"/></string></values></list></container>
      <string key="org:resource" value="Ann"/>
    </event>
    <event/>
  </trace>
  <trace/>
  <trace><event><string key="concept:name" value="alone"/></event></trace>
</log>
"""


def expected(text):
    """What an own walk over the tree gives: owner, number of the trace, event, places, keys, kind, value."""
    ns = "{http://www.xes-standard.org/}"
    out = []

    def walk(element, owner, trace, pos, places, keys):
        children = []
        for c in element:
            children += list(c) if c.tag == f"{ns}values" else [c]
        for i, c in enumerate(x for x in children if x.tag != f"{ns}event"):
            out.append((owner, trace, pos, (*places, i), (*keys, c.get("key")), c.tag.removeprefix(ns), c.get("value")))
            walk(c, owner, trace, pos, (*places, i), (*keys, c.get("key")))

    for n, t in enumerate(x for x in ElementTree.fromstring(text).iter(f"{ns}trace") if len(x)):
        walk(t, "trace", n, None, (), ())
        for p, e in enumerate(t.iter(f"{ns}event")):
            walk(e, "event", n, p, (), ())
    return sorted(out, key=str)


def listed(rows):
    found = rows.filter("kind is not null and owner in ('trace', 'event')").collect()
    dense = {t: n for n, t in enumerate(sorted({r.trace for r in rows.filter("owner = 'trace'").collect()}))}
    return sorted(((r.owner, dense[r.trace], r.pos, tuple(r.place), tuple(r["keys"]), r.kind, r.value) for r in found), key=str)


def test_attributes_of_any_depth(spark, tmp_path):
    (tmp_path / "n.xes").write_text(NESTED)
    path = f"file://{tmp_path}/n.xes"
    rows = attributes.read_attributes(spark, path, defaults=False)
    assert listed(rows) == expected(NESTED)
    assert rows.filter("owner = 'event' and kind is null").count() == 3 and rows.filter("owner = 'trace' and kind is null").count() == 2
    assert [(r.owner, r.value) for r in rows.filter("owner not in ('trace', 'event') and kind is not null").orderBy("owner", "place").collect()] == [("global:event", "nobody"), ("global:event", "0"), ("global:trace", "none"), ("log", "somebody")]
    assert attributes.attribute_at(rows, "cost", "drivers", "driver", "since").first().value == "2019-05-06T08:15:00.000+02:00"
    filled = attributes.read_attributes(spark, path)
    assert sorted((r.pos, r.value) for r in attributes.attribute_at(filled, "org:resource").collect()) == [(0, "Ann"), (0, "nobody"), (1, "nobody")]
    assert attributes.attribute_at(filled, "org:resource", "grade").count() == 2 and attributes.attribute_at(filled, "team").count() == 2


def test_files_with_other_defaults_are_an_error(spark, tmp_path):
    for n, value in enumerate(("a", "b")):
        (tmp_path / f"{n}.xes").write_text(f'<log><global scope="event"><string key="k" value="{value}"/></global><trace><event/></trace></log>')
    with pytest.raises(ValueError):
        attributes.read_attributes(spark, f"file://{tmp_path}")
    assert attributes.read_attributes(spark, f"file://{tmp_path}", defaults=False).filter("owner = 'event'").count() == 2


def test_a_log_without_traces(spark, tmp_path):
    (tmp_path / "e.xes").write_text('<log><string key="k" value="v"/></log>')
    assert attributes.read_attributes(spark, f"file://{tmp_path}/e.xes").filter("owner = 'trace'").count() == 0


def test_three_levels_come_back_from_one_document(spark, tmp_path):
    (tmp_path / "n.xes").write_text(NESTED)
    rows = attributes.read_attributes(spark, f"file://{tmp_path}/n.xes", defaults=False)
    path = tmp_path / "back.xes"
    for _ in range(2):  # the second run replaces the first one's document
        document.write_lines(document.attribute_lines(rows), f"file://{path}")
    assert listed(attributes.read_attributes(spark, f"file://{path}")) == expected(NESTED) == expected(path.read_text())
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []


def strict(path):
    """The document's tree, if its elements stand in the order that the format asks for."""
    root = ElementTree.parse(path).getroot()
    tags = [c.tag.removeprefix("{http://www.xes-standard.org/}") for c in root]
    order = ["extension", "global", "classifier", "string", "trace"]
    assert tags == sorted(tags, key=order.index)
    prefixes = {e.get("prefix") for e in root if e.tag.endswith("extension")}
    assert all(k.split(":")[0] in prefixes for k in (a.get("key") for a in root.iter() if a.get("key")) if ":" in k)
    return root


def test_one_trace_over_many_parts(spark, make_log, tmp_path):
    """A case with most events, written in many ranges, is one trace in order."""
    rng = random.Random(3)
    times = sorted(rng.randrange(100_000) for _ in range(3000))
    log = make_log([(7, f"a<{i % 5}>&", t, 'r"1"') for i, t in enumerate(times)] + [(8, "z", 5), (8, None, 6)]).filter("act is not null").withColumns({"value": F.col("pos") / 4, "more": F.struct(F.array(F.lit(1), F.lit(2)).alias("list"), F.create_map(F.lit("m"), F.lit(True)).alias("map")), "none": F.lit(None).cast("string")})
    header = document.Header(globals={"event": (("string", "concept:name", "?"),)}, attributes=(("string", "source", "a & b"),))
    path = tmp_path / "log.xes"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        document.write_document(log.repartition(5), f"file://{path}", {"value": "value", "more": "more", "none": "none"}, header)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    root = strict(path)
    traces = [t for t in root if t.tag.endswith("trace")]
    assert [len(t) - 1 for t in traces] == [3000, 1]
    back = xes.read_xes(spark, f"file://{path}").filter("case_name = '7'")
    assert back.select("pos", "act", "res", "us").exceptAll(log.filter("case_id = 7").select("pos", "act", "res", "us")).count() == 0 and back.count() == 3000
    rows = attributes.read_attributes(spark, f"file://{path}")
    assert {r.value for r in attributes.attribute_at(rows, "more", "list", "item").collect()} == {"1", "2"}
    assert attributes.attribute_at(rows, "more", "map", "m").first().value == "true" and attributes.attribute_at(rows, "none").count() == 0
    assert attributes.attribute_at(rows, "value").filter("value = '0.25'").count() == 1


def test_an_empty_log_is_a_document(spark, make_log, tmp_path):
    document.write_document(make_log([(1, "a", 1)]).limit(0), f"file://{tmp_path}/none.xes")
    assert [c for c in strict(tmp_path / "none.xes") if c.tag.endswith("trace")] == []
