"""What paths say about cases: paths of high-level activities, the cases that take part, and those that could."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sets import project
from tidemark.storage import Staging, not_broadcast

from . import casebits
from .forest import Found


@dataclass(frozen=True)
class Activities:
    """Paths of high-level activities (hla, hla_path, frequency), the cases of each as words (hla, word, bits), cases' numbers."""

    table: DataFrame
    words: DataFrame
    numbers: DataFrame

    def frequent(self, least: int) -> Activities:
        return Activities(self.table.filter(F.col("frequency") >= least), self.words, self.numbers) if least > 0 else self

    def listing(self) -> DataFrame:
        """(hla_path, frequency, cases), cases as arrays."""
        return listed(self.table, self.words, self.numbers, "cases").select("hla_path", "frequency", "cases")


def listed(table: DataFrame, words: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
    """Adds each path's cases as an array: for files and for eyes."""
    kind = dict(numbers.dtypes)["case_id"]
    sets = casebits.members(words, numbers).groupBy(F.col("hla").alias("_hla")).agg(F.sort_array(F.collect_list("case_id")).alias(name))
    return table.join(sets, F.col("hla") == F.col("_hla"), "left").drop("_hla").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))


def activities_of(found: Found, hles: DataFrame) -> Activities:
    """Paths of feature and entity, without the class: how many paths of events each stands for, and the union of their cases."""
    stage = Staging(hles.sparkSession, "activities")
    hla = hles.select("hle_id", F.struct("f_type", "e1", "e2").alias("hla"))
    at = found.paths.select("number", F.posexplode("path").alias("i", "hle_id")).join(hla, "hle_id")
    named = stage.table(at.groupBy("number").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "hla"))), lambda x: x["hla"]).alias("hla_path")), "named")
    table = stage.table(named.groupBy("hla_path").agg(F.count("*").alias("frequency")).select(F.monotonically_increasing_id().alias("hla"), "hla_path", "frequency"), "table")
    numbered = named.join(table, "hla_path").select(F.col("number").alias("number_"), "hla")
    return Activities(table, stage.table(casebits.union(found.words.join(numbered, "number_"), "hla"), "words"), found.numbers)


def postings(log: DataFrame) -> DataFrame:
    """(a, b, case_id, pos): where in a case's control flow an activity follows another one."""
    place = Window.partitionBy("case_id").orderBy("pos")
    return log.select("case_id", F.row_number().over(place).alias("pos"), F.col("act").alias("a"), F.lead("act").over(place).alias("b")).filter("b is not null")


def cases_with_runs(runs: DataFrame, log: DataFrame) -> DataFrame:
    """(run, case_id): cases whose control flow holds a run (run, acts) of two activities or more without gaps.

    Each run is looked for where its rarest pair of neighbours stands; from there its other pairs are looked up by
    case, place and pair. No run meets all the cases of a frequent pair unless all its pairs are frequent.
    """
    stage = Staging(log.sparkSession, "postings")
    index = stage.table(postings(log), "index")
    often = index.groupBy("a", "b").agg(F.count("*").alias("often"))
    pairs = runs.select("run", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("acts") - 1), lambda i: F.struct(F.element_at("acts", i).alias("a"), F.element_at("acts", i + 1).alias("b")))).alias("i", "p")).select("run", "i", "p.a", "p.b")
    pairs = stage.table(pairs.join(often, ["a", "b"], "left"), "pairs")
    rarest = pairs.groupBy("run").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "i", "a", "b")).alias("r"), F.count("*").alias("length")).select("run", "length", "r.i", "r.a", "r.b")
    starts = index.join(rarest, ["a", "b"]).select("run", "length", F.col("i").alias("seed"), "case_id", (F.col("pos") - F.col("i")).alias("start"))
    wanted = starts.join(pairs.select("run", "i", "a", "b"), "run").filter("i <> seed").withColumn("pos", F.col("start") + F.col("i"))
    rest = wanted.join(not_broadcast(index), ["case_id", "pos", "a", "b"], "left_semi").groupBy("run", "length", "case_id", "start").agg(F.count("*").alias("n")).filter("n = length - 1")
    return rest.select("run", "case_id").unionByName(starts.filter("length = 1").select("run", "case_id")).distinct()


@dataclass(frozen=True)
class Statistics:
    """Paths with their numbers of cases (hla, path, length, frequency, n_relevant, n_participating, n_non_participating), and the
    cases of each as words: participating, and non_participating, other cases whose control flow holds the path's activities."""

    table: DataFrame
    participating: DataFrame
    relevant: DataFrame
    non_participating: DataFrame
    numbers: DataFrame

    def listing(self) -> DataFrame:
        """The table with the cases as arrays beside their numbers."""
        out = self.table
        for name in ("relevant", "participating", "non_participating"):
            out = listed(out, getattr(self, name), self.numbers, name)
        return out.select("path", "length", "frequency", "relevant", "n_relevant", "participating", "n_participating", "non_participating", "n_non_participating")


def statistics(hla: Activities, log: DataFrame, compat: str = "fixed") -> Statistics:
    """For each path: length, frequency, and its relevant, participating and other relevant cases with their numbers."""
    stage = Staging(log.sparkSession, "statistics")
    acts = hla.table.select("hla", "hla_path", project(F.col("hla_path")).alias("acts"))
    if compat == "reference":
        from .paths import case_pool
        from .steps import control_flow

        pool = case_pool(hla.table.select("hla_path").distinct(), control_flow(log), compat)
        hits = pool.join(acts.select("hla", "hla_path"), "hla_path").select("hla", F.explode("relevant").alias("case_id"))
    else:
        runs = stage.table(acts.groupBy("acts").agg(F.min("hla").alias("run")), "runs")
        hits = cases_with_runs(runs, log).join(runs, "run").join(acts, "acts").select("hla", "case_id")
    relevant = stage.table(casebits.as_words(hits, hla.numbers, "hla"), "relevant")
    joined = relevant.join(not_broadcast(hla.words.withColumnRenamed("bits", "taken")), ["hla", "word"], "left")
    rest = joined.select("hla", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("taken", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0")
    out = hla.table.select("hla", F.col("hla_path").alias("path"), F.size("hla_path").alias("length"), "frequency")
    for name, words in (("n_relevant", relevant), ("n_participating", hla.words), ("n_non_participating", rest)):
        out = out.join(casebits.sizes(words, "hla", name=name), "hla", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("int"))
    return Statistics(stage.table(out, "table"), hla.words, relevant, rest, hla.numbers)
