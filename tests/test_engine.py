"""Hand-worked cases and properties of the event-log operators."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import sets
from tidemark.operators import cascade, detect, features, hl_log, link, overlap, paths, stats, steps, windows
from tidemark.plans import analyses
from tidemark.sources import logs, xes

DAY = 86_400


def pairs(df):
    return sorted((r.a_i, r.a_j) for r in df.collect())


def test_ties_give_partial_order(make_log):
    log = make_log([(1, "a", 10), (1, "b", 20), (1, "c", 20), (1, "d", 30)])
    assert pairs(steps.partial_order(log)) == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    assert pairs(steps.total_order(log)) == [("a", "b"), ("b", "c"), ("c", "d")]
    f = windows.frame(log, "days")
    p = analyses.Prepared(windows.with_windows(log, f), windows.steps_with_windows(steps.partial_order(log), f), f)
    count = lambda compat: {r.e1: r.value for r in features.values(("exec",), p.log, p.steps, f, compat).collect()}
    assert count("reference") == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert count("fixed") == {"a": 1, "b": 1, "c": 1, "d": 1}


def test_only_ties_have_no_steps(make_log):
    log = make_log([(1, "a", 10), (1, "b", 10)])
    s = steps.directly_follows(log)
    assert s.count() == 0 and steps.finals(log, s).count() == 2


def test_unknown_method_and_unit(make_log):
    log = make_log([(1, "a", 10)])
    with pytest.raises(ValueError):
        steps.directly_follows(log, "mf")
    with pytest.raises(ValueError):
        windows.frame(log, "weeks")


def test_windows_by_number(make_log):
    log = make_log([(1, "a", t) for t in (0, 2, 4, 6, 8, 10)])
    at = lambda n, c: [r.w for r in windows.with_windows(log, windows.frame(log, n, c)).orderBy("pos").collect()]
    assert at(5, "reference") == [0, 1, 2, 3, 3, 3]
    assert at(5, "fixed") == [0, 1, 2, 3, 4, 4]
    assert at(1, "fixed") == [0] * 6
    with pytest.raises(ValueError):
        windows.frame(log, 1, "reference")


def test_hours_are_rounded_up(make_log, spark):
    log = make_log([(1, "a", 3600), (1, "b", 3600.001)])
    f = windows.frame(log, "hours")
    assert [r.w for r in windows.with_windows(log, f).orderBy("pos").collect()] == [0, 1]
    assert f.borders(spark).orderBy("w").first()[1:] == (0.0, 3600.0)


def test_day_borders(make_log, spark):
    log = make_log([(1, "a", 14973 * DAY + 5)])
    left = lambda c: windows.frame(log, "days", c).borders(spark).first().left_s
    assert left("fixed") == 14973 * DAY and left("reference") == 14972 * DAY


def test_waiting_time(make_log):
    log = make_log([(1, "i", 14 * 3600), (1, "j", DAY + 2 * 3600)])
    wt = lambda c: [r.value for r in _values(log, ("wt",), c).orderBy("w1").collect()]
    assert wt("fixed") == [36000, 43200] and wt("reference") == [-50400, 43200]


def _values(log, chosen, compat="fixed"):
    f = windows.frame(log, "days", compat)
    return features.values(chosen, windows.with_windows(log, f), windows.steps_with_windows(steps.partial_order(log), f), f, compat)


def test_thresholds(spark):
    rows = [("exec", "activity", e, None, w, w, float(v), 1) for w, (e, v) in enumerate(zip("abcde", (0, 1, 2, 3, 10), strict=True))]
    values = spark.createDataFrame(rows, "f_type string, comp_type string, e1 string, e2 string, w1 long, w2 long, value double, n long")
    t = detect.thresholds(values, 0.9).first()
    assert (t.low, t.high) == (pytest.approx(1.3), pytest.approx(7.9))
    found = detect.detect(values, detect.thresholds(values, 0.9), ("High", "Low"))
    assert {r.e1: r["class"] for r in found.collect()} == {"a": "Low", "b": "Low", "e": "High"}
    zeros = values.withColumn("value", F.lit(0.0))
    t = detect.thresholds(zeros, 0.9).first()
    assert (t.low, t.high) == (0.0, 1e10)
    with pytest.raises(ValueError):
        detect.thresholds(values, 90)


def test_links_of_two_cases(make_log):
    log = make_log([(1, "a", 0, "r1"), (1, "b", 1, "r2"), (2, "a", 0, "r1"), (2, "b", 1, "r1")])
    s = steps.total_order(log)
    get = lambda k: {(r.x1, r.y1): round(r.weight, 6) for r in link.raw_links(k, log, s).collect()}
    assert get("aa")[("a", "b")] == 1
    assert get("rr") == {("r1", "r1"): round(1 / 3, 6), ("r1", "r2"): round(1 / 3, 6), ("r2", "r1"): round(1 / 3, 6)}
    assert get("rs") == {("r1", "a"): 0.75, ("r2", "a"): 0.5}
    even = link.spread(link.links(log, s, ("rs",)))
    assert {r.x1: r.weight for r in even.collect()} == {"r1": 1.0, "r2": 0.5}


def test_spread(spark):
    rows = [("aa", str(i), None, "y", None, w) for i, w in enumerate((0.0, 0.1, 0.15, 0.2, 1.0))]
    found = link.spread(spark.createDataFrame(rows, "kind string, x1 string, x2 string, y1 string, y2 string, weight double"))
    assert sorted(r.weight for r in found.collect()) == [0, 0.25, 0.5, 0.75, 1]


def _hles(spark, rows):
    cols = "f_type string, comp_type string, e1 string, e2 string, w1 long, w2 long, value double, class string"
    return spark.createDataFrame(rows, cols).withColumn("hle_id", detect.hle_id())


def test_cascades_join_neighbouring_windows_alone(spark):
    rows = [("exec", "activity", "a", None, w, w, 5.0, "High") for w in (0, 2, 3)]
    no_links = spark.createDataFrame([], "kind string, x1 string, x2 string, y1 string, y2 string, weight double")
    found = cascade.cascades(_hles(spark, rows), no_links, 0.5)
    assert len({r.cascade for r in found.collect()}) == 2


def test_flat_log(spark, make_log):
    hles = _hles(spark, [("exec", "activity", e, None, 0, 0, v, "High") for e, v in (("b", 1.0), ("a", 2.0))])
    f = windows.frame(make_log([(1, "a", 0)]), "days")
    cascades = hles.select("hle_id", F.col("hle_id").alias("cascade"))
    rows = lambda c: [(r.activity, r.value, r.at_s) for r in hl_log.flat_log(hles, cascades, detect.filter_hla(hles, 0), f, compat=c).orderBy("at_s").collect()]
    assert rows("fixed") == [("exec-High-a", 2.0, 0.0), ("exec-High-b", 1.0, DAY / 2)]


def test_filter_hla(spark):
    rows = [("exec", "activity", e, None, w, w, 1.0, "High") for e, n in (("x", 5), ("y", 3), ("z", 1)) for w in range(n)]
    top = lambda c: {r.e1 for r in detect.filter_hla(_hles(spark, rows), 2, c).collect()}
    assert top("fixed") == {"x", "y"} and top("reference") == {"y", "z"}


def test_small_digraph(spark):
    """P leads to Q and R, R to S; Q's cases are too few to go on from, S and T share none."""
    cases = {"P": [10, 11, 12], "Q": [10], "R": [11, 12], "S": [11, 12, 13], "T": [20]}
    sets_ = spark.createDataFrame(list(cases.items()), "hle_id string, cases array<long>")
    arcs = spark.createDataFrame([tuple(x) for x in "PQ PR RS PS ST".split()], "src string, dst string")
    found = paths.hle_paths(sets_.select("hle_id"), arcs, sets_, 0.5)
    got = {"".join(r.path): sorted(r.cases) for r in found.collect()}
    assert got == {"PRS": [11, 12], "PS": [11, 12], "RS": [11, 12], "Q": [10], "S": [11, 12, 13], "T": [20]}
    assert paths.maximal(found).count() == 6
    with pytest.raises(ValueError):
        paths.hle_paths(sets_.select("hle_id"), arcs, sets_, 0.0, longest=1)
    assert sorted("".join(r.path) for r in paths.hle_paths(sets_.select("hle_id"), arcs, sets_, 0.5, only_maximal=False).collect()).count("RS") == 3


def test_case_pool_by_elements_and_by_joined_names(spark):
    flows = spark.createDataFrame([(1, ["xa", "b", "c"]), (2, ["a", "b", "c"]), (3, ["a", "bc"]), (4, ["c"]), (5, ["a", "c", "b"])], "case_id long, flow array<string>")
    made = spark.createDataFrame([([("enter", "a", "b")],), ([("exit", "a", "b"), ("exit", "b", "c")],)], "hla_path array<struct<f_type:string,e1:string,e2:string>>")
    pool = lambda compat: {len(r.hla_path): r.relevant for r in paths.case_pool(made, flows, compat).collect()}
    assert pool("fixed") == {1: [2], 2: [2]}
    assert pool("reference") == {1: [1, 2, 3], 2: [1, 2]}
    assert paths.case_pool(made.limit(0), flows, "reference").count() == 0


def test_runs_in_sequences(spark):
    df = spark.createDataFrame([(["xa#bc"], ["a#b"])], "flow array<string>, run array<string>")
    assert df.select(sets.contains_joined(F.col("flow"), F.col("run"))).first()[0]
    assert not df.select(sets.contains_run(F.col("flow"), F.col("run"))).first()[0]
    empty = spark.createDataFrame([([], [])], "a array<long>, b array<long>")
    assert empty.select(sets.jaccard(F.col("a"), F.col("b"))).first()[0] == 0


def test_tests_of_significance(spark):
    table = spark.createDataFrame([(10, 20, 30, 40), (0, 0, 0, 0)], "a long, b long, c long, d long")
    x = table.select(stats.chi_square([[F.col("a"), F.col("b")], [F.col("c"), F.col("d")]]).alias("x")).collect()
    assert x[0].x == pytest.approx(0.793651, abs=1e-6) and x[1].x is None
    assert stats.chi_square_tail(0.793651, 1) == pytest.approx(0.373, abs=5e-4)
    assert stats.chi_square_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_tail(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert stats.fisher_exact(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-6)
    assert stats.fisher_exact(0, 0, 0, 0) == 1


def test_properties_of_features(spark, make_log):
    rows = [(c, "abc"[(c * 7 + i * 3) % 3], 3600 * (i * (c + 5) + c), f"r{(c + i) % 3}") for c in range(12) for i in range(9)]
    log = make_log(rows)
    n_steps = steps.partial_order(log).count()
    values = _values(log, features.LOG_FEATURES)
    total = {r.f_type: r.t for r in values.groupBy("f_type").agg(F.sum("value").alias("t")).collect()}
    assert total["enter"] == total["exit"] == n_steps
    assert total["exec"] == log.count() == total["do"]
    assert total["busy"] == total["do"] + total["todo"]
    one = values.groupBy("e1", "e2", "w1").pivot("f_type", ["cross", "enter", "exit"]).sum("value").filter("enter is not null or exit is not null")
    assert one.filter("cross < greatest(coalesce(enter, 0), coalesce(exit, 0))").count() == 0


def test_low_zeros_and_analysis(spark, make_log):
    rows = [(c, "abcd"[i], DAY * (c % 7) + 3600 * i + c, f"r{c % 2}") for c in range(40) for i in range(4)]
    log = make_log(rows)
    found = analyses.cascade_log(log, traffic=("High", "Low"), share=0.8)
    assert {"case", "activity", "at_s", "value", "component"} == set(found.columns)
    analysis = analyses.path_analysis(log, share=0.5, least_overlap=0.1, least_path_overlap=0.1, segment_share=0)
    known = {r.hle_id: set(r.cases) for r in analysis.cases.collect()}
    for r in analysis.paths.collect():
        common = set.intersection(*(known.get(h, set()) for h in r.path))
        assert set(r.cases) == common
    study = analyses.outcome_study(log, complete=("a",), success="d", share=0.5, path_frequency=0, least_overlap=0.1, least_path_overlap=0.1)
    assert set(study) == {"statistics", "success", "throughput"}
    # every case has the same activities, so no path depends on the outcome
    assert study["success"].count() == study["throughput"].count() == 0
    assert study["success"].columns == ["length", "frequency", "path", "part_succ", "part_notsucc", "nonpart_succ", "nonpart_notsucc", "p"]
    chosen = analyses.path_analysis(log, share=0.5, least_overlap=0.1, least_path_overlap=0.1, segment_share=0, activities=("a", "b"), resources=())
    assert {(r.e1, r.e2) for r in chosen.hles.collect()} <= {("a", "b")}
    only = analyses.cascade_log(log, traffic=("High", "Low"), share=0.5, activities=("a",), resources=("r1",), only_component=True)
    assert {"a"} <= {r.activity for r in only.collect()} <= {"a", "r1"}


def test_overlap_of_places_and_times(spark):
    rows = [("batch", "segment", "a", "b", 0, 2, 1.0, "High"), ("batch", "segment", "b", "c", 2, 3, 1.0, "High"), ("batch", "segment", "c", "d", 5, 6, 1.0, "High")]
    hles = _hles(spark, rows).withColumns({c: F.lit(None).cast("long") for c in ("w_i_min", "w_i_max", "w_j_min", "w_j_max")})
    cases = hles.select("hle_id", F.array(F.lit(1).cast("long")).alias("cases"))
    assert overlap.arcs(overlap.spreads(hles), cases, 0.5).count() == 1


def test_xes_round_trip(spark, make_log, tmp_path):
    log = make_log([(1, "a", 1000.5, "r"), (1, "b", 2000, "s"), (2, "c & d", 5, "r")])
    xes.write_xes(log, f"file://{tmp_path}/log")
    back = xes.read_xes(spark, f"file://{tmp_path}/log")
    got = sorted((r.case_name, r.pos, r.act, r.res, r.us) for r in back.collect())
    assert got == [("1", 0, "a", "r", 1_000_500_000), ("1", 1, "b", "s", 2_000_000_000), ("2", 0, "c & d", "r", 5_000_000)]
    assert xes.trace_order(back).count() == 2


def test_csv_and_cache(spark, make_log, tmp_path):
    log = make_log([(1, "a", 1), (1, "b", 2)])
    logs.write_csv(steps.control_flow(log), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first().flow == '["a","b"]'
    made = []
    for _ in range(2):
        assert logs.cached(spark, f"file://{tmp_path}/cache", lambda: made.append(1) or log).count() == 2
    assert made == [1]


def test_empty_log(make_log):
    log = make_log([(1, "a", 1)]).limit(0)
    assert steps.partial_order(log).count() == 0
    assert windows.frame(log).last == -1
    assert not math.isnan(windows.frame(log).size)


def test_streaming_windows(spark, tmp_path):
    from tidemark.streaming.windows import activity_counts, stream_steps

    rows = [(1, "a", "2024-01-01 01:00:00"), (1, "b", "2024-01-02 01:00:00"), (2, "a", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "case_id long, act string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"file://{tmp_path}/in")
    read = lambda: spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    for name, stream, mode in (("counts", activity_counts(read()), "complete"), ("steps", stream_steps(read()), "append")):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.act, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
    assert [(r.a_i, r.a_j) for r in spark.table("steps").collect()] == [("a", "b")]
