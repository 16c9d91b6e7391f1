"""What grows with a log stays out of single tasks and of the driver: seen in plans and partitions of small logs."""

from conftest import SMALL

from tidemark.llm import spelling
from tidemark.plans import queries
from tidemark.sources import document, xes
from tidemark.storage import Staging


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_document_is_read_by_many_tasks(spark, make_log, tmp_path):
    path = f"file://{tmp_path}/log.xes"
    log = make_log([(c, f"a{i % 3}", 10 * c + i, "r") for c in range(60) for i in range(9)])
    document.write_document(log, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        back = xes.read_xes(spark, path)
        assert back.rdd.getNumPartitions() > 4
        wanted = log.selectExpr("cast(case_id as string)", "pos", "act", "res", "us")
        found = back.select("case_name", "pos", "act", "res", "us")
        assert found.exceptAll(wanted).count() == 0 and found.count() == 540
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_comments_and_empty_traces_between_pieces(spark, tmp_path):
    event = '<event><string key="concept:name" value="{}"/><date key="time:timestamp" value="2019-05-06T08:15:00.000Z"/></event>'
    (tmp_path / "log.xes").write_text(f'<log><!-- <trace> none --><traces/><trace/>\n<trace a="b">{event.format("x")}<!-- <trace> --></trace><trace />  <trace>\n{event.format("y")}{event.format("z")}</trace><trace/></log>')
    rows = xes.read_xes(spark, f"file://{tmp_path}/log.xes").orderBy("case_id", "pos").collect()
    assert [(r.act, r.pos) for r in rows] == [("x", 0), ("y", 0), ("z", 1)] and len({r.case_id for r in rows}) == 2


def test_a_document_is_parsed_once(spark):
    assert "MapInArrow" not in plan(queries.xes_attributes(spark, SMALL))


def test_case_sets_read_the_staged_log(spark):
    """Six features that each make the log anew would do so in one task, by windows."""
    assert "Window" not in plan(queries.hle_case_sets(spark, SMALL))


def recorded(monkeypatch):
    plans, table = [], Staging.table
    monkeypatch.setattr(Staging, "table", lambda self, df, label: plans.append((label, plan(df))) or table(self, df, label))
    return plans


def test_rows_of_cases_are_never_broadcast(spark, monkeypatch):
    """Their files are small beside their rows, so that Spark would."""
    plans = recorded(monkeypatch)
    table = queries.path_statistics(spark, SMALL)
    found = {label: p for label, p in plans}
    assert "BroadcastHashJoin [_often" not in found["ranges"] and "BroadcastHashJoin [case_id" not in found["ranges"]
    assert not [p for label, p in plans if label == "arcs" and "BroadcastHashJoin [other" in p]
    assert not [p for label, p in plans if label == "relevant" and "BroadcastHashJoin [case_id#" in p and "LeftSemi" in p.split("BroadcastHashJoin [case_id#")[1].split("\n")[0]]
    assert table.count() > 0


def test_roots_of_words_are_never_broadcast(spark, monkeypatch):
    plans = recorded(monkeypatch)
    docs = spark.createDataFrame([(i, "letters letterss lettters " + "letters " * 30) for i in range(20)], "doc_id long, text string")
    out = spelling.variants(docs)
    steps = [p for _, p in plans if "beyond" in p] + [plan(out)]
    assert len(steps) > 1 and not [p for p in steps if "BroadcastHashJoin" in p]
    assert out.filter("root = 'letters'").count() > 1
