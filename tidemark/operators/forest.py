"""Paths as a forest: a node is an event behind its parent's path, so prefixes that paths share are kept once.

Each round extends the newest nodes by one event. A node's cases, those of all its path, are bits (casebits) and get their
next ones by a section with the new event's. Whole paths are put together once, at the end, from the last events up.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import Staging

from . import casebits
from .overlap import as_rows
from .ranks import ranked


@dataclass(frozen=True)
class Found:
    """Paths (number, path) of event ids, the cases of each as words, and the cases' numbers."""

    paths: DataFrame
    words: DataFrame
    numbers: DataFrame

    def listing(self) -> DataFrame:
        """(path, cases), cases as arrays."""
        kind = dict(self.numbers.dtypes)["case_id"]
        sets = casebits.members(self.words, self.numbers).groupBy("number_").agg(F.sort_array(F.collect_list("case_id")).alias("cases"))
        out = self.paths.join(sets, F.col("number") == F.col("number_"), "left")
        return out.select("path", F.coalesce("cases", F.array().cast(f"array<{kind}>")).alias("cases"))


def _on_path(pairs: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(node, dst) of pairs whose dst stands on the node's path already: parents are followed up to the root."""
    at, hits = pairs.select("node", "dst", F.col("node").alias("at")), []
    for nodes in reversed(rounds):
        up = at.join(nodes.select(F.col("node").alias("at"), "parent", "hle_id"), "at")
        hits.append(up.filter("hle_id = dst").select("node", "dst"))
        at = up.filter("hle_id <> dst").select("node", "dst", F.col("parent").alias("at"))
    return reduce(DataFrame.unionByName, hits)


def grow(nodes: DataFrame, arcs: DataFrame, cases: DataFrame, least: float, only_maximal: bool = True, longest: int | None = None, numbers: DataFrame | None = None) -> Found:
    """From every node, each path that no neighbour extends. A neighbour extends a path if it is not on it and the path's common cases
    overlap with its own by ``least``. ``cases`` are sets or rows (hle_id, case_id).

    The number of simple paths can grow exponentially: ``longest`` raises an error if some path would get longer.
    ``only_maximal=False`` adds each extending arc as a path of two, as often as paths take it.
    """
    spark = nodes.sparkSession
    stage = Staging(spark, "forest")
    rows = as_rows(cases)
    if numbers is None:
        numbers = stage.table(ranked(rows.select("case_id").distinct(), [], ["case_id"]).withColumnRenamed("before", "number"), "numbers")
    own = stage.table(casebits.as_words(rows, numbers, "hle_id"), "own")
    sizes = casebits.sizes(own, "hle_id")
    known = nodes.select("hle_id").join(sizes, "hle_id", "left").select("hle_id", F.coalesce("n", F.lit(0)).alias("n"))
    new_id = F.monotonically_increasing_id()
    first = stage.table(known.select(new_id.alias("node"), F.lit(-1).cast("long").alias("parent"), "hle_id", "n", F.col("hle_id").alias("top")), "nodes-0")
    arc = stage.table(arcs.select(F.col("src").alias("hle_id"), "dst").distinct().join(known.select(F.col("hle_id").alias("dst"), F.col("n").alias("m")), "dst"), "arcs")
    rounds, sets = [first], [first.select("node", "hle_id").join(own, "hle_id").select("node", "word", "bits")]
    while True:
        turn = len(rounds)
        pairs = rounds[-1].join(arc, "hle_id").select("node", "dst", "n", "m", "top")
        # an event behind all of a path in order can't be on it; only others are looked up
        back = pairs.filter("dst <= top")
        pairs = pairs.join(_on_path(back, rounds), ["node", "dst"], "left_anti")
        theirs = own.select(F.col("hle_id").alias("dst"), "word", F.col("bits").alias("bits_"))
        both = pairs.select("node", "dst").join(sets[-1], "node").join(theirs, ["dst", "word"])
        both = stage.table(both.select("node", "dst", "word", F.col("bits").bitwiseAND(F.col("bits_")).alias("bits")).filter("bits <> 0"), f"both-{turn}")
        shared = pairs.join(casebits.sizes(both, "node", "dst", name="common"), ["node", "dst"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
        union = F.col("n") + F.col("m") - F.col("common")
        fits = F.when(union == 0, F.lit(0.0)).otherwise(F.col("common") / union) >= least
        grown = shared.filter(fits).select(new_id.alias("node"), F.col("node").alias("parent"), F.col("dst").alias("hle_id"), F.col("common").alias("n"), F.greatest("top", "dst").alias("top"))
        grown = stage.table(grown, f"nodes-{turn}")
        if grown.isEmpty():
            break
        if longest is not None and turn >= longest:
            raise ValueError(f"paths of more than {longest} events; raise `longest` or the overlaps asked for")
        rounds.append(grown)
        named = grown.select(F.col("node").alias("_new"), F.col("parent").alias("node"), F.col("hle_id").alias("dst"))
        sets.append(both.join(named, ["node", "dst"]).select(F.col("_new").alias("node"), "word", "bits"))
    return _expanded(stage, rounds, sets, own, numbers, only_maximal)


def _expanded(stage: Staging, rounds: list[DataFrame], sets: list[DataFrame], own: DataFrame, numbers: DataFrame, only_maximal: bool) -> Found:
    """Whole paths from the nodes that nothing extends, the deepest first, each joined with its parent once."""
    at, words, arcs = None, [], []
    for depth in range(len(rounds) - 1, -1, -1):
        nodes = rounds[depth]
        ends = nodes.select("node").join(rounds[depth + 1].select(F.col("parent").alias("node")), "node", "left_anti") if depth + 1 < len(rounds) else nodes.select("node")
        ends = ends.select(F.lit(depth).alias("depth"), F.col("node").alias("leaf"), "node", F.array().cast("array<string>").alias("path"))
        words.append(sets[depth].withColumn("depth", F.lit(depth)).join(ends.select("leaf"), F.col("node") == F.col("leaf"), "left_semi").select("depth", F.col("node").alias("leaf"), "word", "bits"))
        at = ends if at is None else at.unionByName(ends)
        at = at.join(nodes.select("node", "parent", "hle_id"), "node").select("depth", "leaf", F.col("parent").alias("node"), F.concat(F.array("hle_id"), "path").alias("path"))
        if depth and not only_maximal:
            up = rounds[depth - 1].select(F.col("node").alias("parent"), F.col("hle_id").alias("src"))
            arcs.append(nodes.join(up, "parent").select(F.lit(-depth).alias("depth"), F.col("node").alias("leaf"), "src", F.col("hle_id").alias("dst")))
    if arcs:
        all_arcs = stage.table(reduce(DataFrame.unionByName, arcs), "extensions")
        side = lambda name, bits: own.select(F.col("hle_id").alias(name), "word", F.col("bits").alias(bits))
        common = all_arcs.join(side("src", "b1"), "src").join(side("dst", "b2"), ["dst", "word"]).withColumn("bits", F.col("b1").bitwiseAND(F.col("b2")))
        words.append(common.filter("bits <> 0").select("depth", "leaf", "word", "bits"))
        at = at.select("depth", "leaf", "path").unionByName(all_arcs.select("depth", "leaf", F.array("src", "dst").alias("path")))
    paths = stage.table(at.select(F.monotonically_increasing_id().alias("number"), "depth", "leaf", "path"), "paths")
    found = reduce(DataFrame.unionByName, words).join(paths.select("number", "depth", "leaf"), ["depth", "leaf"])
    return Found(paths.select("number", "path"), stage.table(found.select(F.col("number").alias("number_"), "word", "bits"), "words"), numbers)
