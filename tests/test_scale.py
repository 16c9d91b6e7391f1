"""Forms that survive long spans, hot groups and large sets, against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.operators import casebits, cascade, detect, features, forest, overlap, participation, ranks, stats, steps, windows
from tidemark.storage import Staging

DAY = 86_400
HLE = "f_type string, comp_type string, e1 string, e2 string, w1 long, w2 long, value double, class string"


def parts_of(log, width, compat="fixed"):
    f = windows.frame(log, width, compat)
    return windows.with_windows(log, f), windows.steps_with_windows(steps.partial_order(log), f), f


@pytest.mark.parametrize("compat", ["fixed", "reference"])
def test_span_features_equal_their_instances(make_log, compat):
    """Spans over several blocks of minutes, ties, gaps without changes, and steps within one window."""
    rng = random.Random(5)
    rows = [(c, rng.choice("abc"), t, f"r{rng.randrange(2)}") for c in range(6) for t in sorted(rng.choice((60, 61, 5_000, 90_000, 90_001, 200_000, 300_030)) + rng.randrange(3) * 30 for _ in range(5))]
    log, made, f = parts_of(make_log(rows), "minutes", compat)
    show = lambda df: sorted((r.f_type, r.comp_type, r.e1, r.e2 or "", r.w1, round(r.value, 5), r.n) for r in df.select("f_type", "comp_type", "e1", "e2", "w1", "value", "n").collect())
    for x in features.SPANS:
        assert show(features.values((x,), log, made, f, compat)) == show(features.evaluate(features.instances(x, log, made, f, compat), x)), x


def test_a_long_step_costs_two_rows(make_log):
    log, made, f = parts_of(make_log([(1, "a", 0, "r"), (1, "b", 365 * DAY, "r")]), "minutes")
    assert features.changes("cross", log, made, f).count() == 2
    stage = Staging(made.sparkSession, "test")
    assert features.open_runs(features.changes("cross", log, made, f), stage).count() <= 4
    values = features.values(("cross", "wt"), log, made, f)
    assert values.groupBy("f_type").agg(F.count("*").alias("n"), F.max("value").alias("m")).orderBy("f_type").collect() == [("cross", 525_601, 1.0), ("wt", 525_601, 365.0 * DAY)]


def test_reference_mode_on_an_empty_log(make_log):
    log, made, f = parts_of(make_log([(1, "a", 1)]).limit(0), "days", "reference")
    assert features.values(("to-exec",), log, made, f, "reference").count() == 0
    assert features.instances("to-exec", log, made, f, "reference").count() == 0


def test_percentiles_and_ranks_by_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaaaab"), None if rng.random() < 0.1 else round(rng.gauss(0, 1), rng.choice((1, 6)))) for _ in range(3000)] + [("c", 1.0), ("d", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    found = {r.k: r for r in ranks.percentiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    for k in ("a", "b", "c", None):
        own = [v for q, v in rows if q == k and v is not None]
        assert [found[k].low, found[k].mid, found[k].top] == pytest.approx(np.quantile(own, [0.1, 0.5, 1.0]).tolist())
    assert "d" not in found
    whole = ranks.percentiles(df, [], "v", {"mid": 0.25}).first()
    assert whole.mid == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25))
    placed = ranks.ranked(df.filter("v is not null").distinct(), ["k"], ["v"]).collect()
    for k in ("a", "b"):
        assert [r.before for r in sorted((r for r in placed if r.k == k), key=lambda r: r.v)] == list(range(len({v for q, v in rows if q == k and v is not None})))
    assert ranks.percentiles(df.limit(0), ["k"], "v", {"mid": 0.5}).count() == 0


def test_ids_tell_names_with_marks_apart(spark):
    names = [("A|B", "C"), ("A", "B|C"), ("A\\", "B"), ("A", "\\|B"), ("A\\|", "B"), ("A", "|B")]
    df = spark.createDataFrame([("enter", "segment", a, b, 0, 0, 1.0, "High") for a, b in names], HLE)
    assert df.select(detect.hle_id()).distinct().count() == len(names)


def test_without_a_least_link_all_neighbouring_windows_join(spark):
    df = spark.createDataFrame([("exec", "activity", e, None, w, w, 1.0, "High") for e, w in (("a", 0), ("b", 0), ("c", 1), ("d", 3), ("e", 3), ("f", 5), ("g", 4))], HLE).withColumn("hle_id", detect.hle_id())
    none = spark.createDataFrame([], "kind string, x1 string, x2 string, y1 string, y2 string, weight double")
    found = {r.hle_id.split("|")[4]: r.cascade for r in cascade.cascades(df, none, 0).collect()}
    assert found["a"] == found["b"] == found["c"] and found["d"] == found["e"] == found["f"] == found["g"] != found["a"]
    with pytest.raises(ValueError):
        cascade.edges(df, none, 0)


def random_events(spark, seed, n=14):
    rng = random.Random(seed)
    rows, sets = [], {}
    for i in range(n):
        a, b, w = rng.choice("abc"), rng.choice("abc"), rng.randrange(3)
        rows.append((f"h{i:02}", "batch", "segment", a, b, w, w + rng.randrange(1, 3)))
        sets[f"h{i:02}"] = sorted(rng.sample(range(8), rng.randrange(0, 7)))
    df = spark.createDataFrame(rows, "hle_id string, f_type string, comp_type string, e1 string, e2 string, w1 long, w2 long")
    df = df.withColumns({c: F.lit(None).cast("long") for c in ("w_i_min", "w_i_max", "w_j_min", "w_j_max")})
    return df, sets, spark.createDataFrame([(h, c) for h, s in sets.items() for c in s], "hle_id string, case_id long")


def share(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


@pytest.mark.parametrize("least", [0, 0.3, 0.5, 1.0])
def test_similar_sets_of_cases_by_brute_force(spark, least):
    df, sets, rows = random_events(spark, 7, 40)
    made = overlap.spreads(df)
    near = {(r.src, r.dst) for r in overlap.near(made).collect()}
    found = {(r.src, r.dst): r.overlap for r in overlap.arcs(made, rows, least).collect()}
    want = {p: round(share(sets[p[0]], sets[p[1]]), 9) for p in near}
    assert found == {p: x for p, x in want.items() if x >= least} and near


@pytest.mark.parametrize(("seed", "least", "only"), [(1, 0.3, True), (1, 0.3, False), (2, 0, True), (3, 0.5, False)])
def test_path_forest_by_brute_force(spark, seed, least, only):
    """Graphs with cycles and with events that share no case."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(6)]
    sets = {x: sorted(rng.sample(range(6), rng.randrange(0, 6))) for x in names}
    arcs = sorted(rng.sample([(a, b) for a in names for b in names if a != b], 9))
    want = []

    def walk(path, cases):
        ends = True
        for a, b in arcs:
            if a == path[-1] and b not in path and share(cases, sets[b]) >= least:
                ends = False
                if not only:
                    want.append(((a, b), tuple(sorted(set(sets[a]) & set(sets[b])))))
                walk([*path, b], set(cases) & set(sets[b]))
        if ends:
            want.append((tuple(path), tuple(sorted(cases))))

    for x in names:
        walk([x], set(sets[x]))
    rows = spark.createDataFrame([(h, c) for h, s in sets.items() for c in s], "hle_id string, case_id long")
    nodes = spark.createDataFrame([(x,) for x in names], "hle_id string")
    found = forest.grow(nodes, spark.createDataFrame(arcs, "src string, dst string"), rows, least, only)
    assert sorted((tuple(r.path), tuple(r.cases)) for r in found.listing().collect()) == sorted(want)


def test_statistics_by_bits_equal_sets(spark, make_log):
    """Runs in control flows by postings, sections and differences by bits, contingency by parts, against sets and lists."""
    rng = random.Random(4)
    flows = {c: [rng.choice("abc") for _ in range(rng.randrange(1, 9))] for c in range(150)}
    log = make_log([(c, a, 10 * i + c) for c, acts in flows.items() for i, a in enumerate(acts)])
    numbers = casebits.numbered(log)
    assert sorted(r.number for r in numbers.collect()) == list(range(150))
    made = [list(p) for n in (1, 2, 3) for p in itertools.islice(((("enter", x, y), *((("exit", z, w),) if n > 1 else ()), *((("exit", w, "a"),) if n > 2 else ())) for x, y in itertools.product("abc", repeat=2) for z, w in ((y, "b"),)), 9)]
    took = {i: sorted(rng.sample(range(150), rng.randrange(0, 60))) for i in range(len(made))}
    table = spark.createDataFrame([(i, [tuple(s) for s in p], 3) for i, p in enumerate(made)], "hla long, hla_path array<struct<f_type:string,e1:string,e2:string>>, frequency long")
    words = casebits.as_words(spark.createDataFrame([(i, c) for i, cs in took.items() for c in cs], "hla long, case_id long"), numbers, "hla")
    found = participation.statistics(participation.Activities(table, words, numbers), log)
    partition = spark.createDataFrame([(c, c % 3) for c in range(140)], "case_id long, part int")
    cells = {r.hla: r.table for r in stats.contingency(found, partition, 3).collect()}
    listed = {tuple(tuple(s) for s in r.path): r for r in found.listing().collect()}
    assert len(listed) == len({tuple(p) for p in made})
    for i, p in enumerate(made):
        run = [p[0][1], *(s[2] for s in p)]
        relevant = {c for c, acts in flows.items() if any(acts[k : k + len(run)] == run for k in range(len(acts)))}
        r = listed[tuple(p)]
        if made.count(p) == 1:
            assert (set(r.relevant), r.participating, set(r.non_participating)) == (relevant, took[i], relevant - set(took[i]))
            assert (r.n_relevant, r.n_participating, r.n_non_participating, r.length) == (len(relevant), len(took[i]), len(relevant - set(took[i])), len(p))
        assert cells[i] == [[sum(c % 3 == k and c < 140 for c in x) for k in range(3)] for x in (set(took[i]), relevant - set(took[i]))]


def test_tails_on_columns(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(0, m) for _ in range(4)) for m in (2, 5, 40, 300) for _ in range(25)] + [(0, 0, 0, 0), (8, 2, 1, 5), (5_000_000, 5_001_000, 4_999_000, 5_000_500)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    for r in df.withColumn("p", tails.fisher_p(*[F.col(x) for x in "abcd"])).limit(102).collect():
        assert r.p == pytest.approx(stats.fisher_exact(r.a, r.b, r.c, r.d), abs=1e-6)
    large = df.filter("a > 1000000").withColumn("p", tails.fisher_p(*[F.col(x) for x in "abcd"])).first()
    assert large.p == pytest.approx(0.910947, abs=2e-4)  # the normal distribution's
    xs = spark.createDataFrame([(x,) for x in (0.0, 0.01, 0.79, 3.8, 9.5, 17.9, 18.1, 40.0, 200.0)], "x double")
    for k in (1, 2, 3, 4, 7):
        for r in xs.coalesce(1).withColumn("p", tails.chi_square_p(F.col("x"), k)).collect():
            assert r.p == pytest.approx(stats.chi_square_tail(r.x, k), rel=1e-7, abs=1e-300)
    assert xs.limit(1).select(tails.chi_square_p(F.lit(None).cast("double"), 1).alias("p")).first().p is None
