"""Partitions of cases by outcome, and tests whether paths and partitions depend on each other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tails import chi_square_p, fisher_p

from . import casebits
from .participation import Statistics


def throughput_partition(log: DataFrame, edges: tuple[int, int] = (10, 30)) -> DataFrame:
    """(case_id, part): 0 up to 10 whole days, 1 under 30, 2 beyond."""
    days = F.floor((F.max("us") - F.min("us")) / F.lit(86_400_000_000))
    return log.groupBy("case_id").agg(F.when(days <= edges[0], 0).when(days < edges[1], 1).otherwise(2).alias("part"))


def outcome_partition(log: DataFrame, activity: str = "A_Pending") -> DataFrame:
    """(case_id, part): 0 if the case has the activity, else 1."""
    return log.groupBy("case_id").agg(F.when(F.max((F.col("act") == activity).cast("int")) == 1, 0).otherwise(1).alias("part"))


def amount_partition(cases: DataFrame, amount: str, most: float = 10_000) -> DataFrame:
    """(case_id, part): 0 up to the amount, else 1; cases without an amount are in no part."""
    return cases.filter(F.col(amount).isNotNull()).select("case_id", F.when(F.col(amount) <= most, 0).otherwise(1).alias("part")).distinct()


def contingency(paths: DataFrame | Statistics, partition: DataFrame, parts: int) -> DataFrame:
    """Adds table: counts of participating and other relevant cases by part, as two arrays in one.

    Of Statistics, paths' words of cases meet those of the parts, and bits of both are counted. Of listings (arrays), cases are
    joined with their part.
    """
    if isinstance(paths, Statistics):
        words = casebits.as_words(partition.select("case_id", "part").distinct(), paths.numbers, "part")
        by_word = words.groupBy("word").agg(*[F.bit_or(F.when(F.col("part") == p, F.col("bits"))).alias(f"p{p}") for p in range(parts)])
        out = paths.table
        for r, sets in ((0, paths.participating), (1, paths.non_participating)):
            both = lambda p: F.col("bits").bitwiseAND(F.coalesce(f"p{p}", F.lit(0).cast("long")))
            counts = sets.join(by_word, "word").groupBy("hla").agg(*[casebits.size(both(p)).alias(f"n{r}{p}") for p in range(parts)])
            out = out.join(counts, "hla", "left")
        return _tabled(out, parts)
    rows = [paths.select("path", F.lit(r).alias("row"), F.explode(c).alias("case_id")) for r, c in ((0, "participating"), (1, "non_participating"))]
    counts = rows[0].unionByName(rows[1]).join(partition, "case_id").groupBy("path").agg(*[F.count_if((F.col("row") == r) & (F.col("part") == p)).alias(f"n{r}{p}") for r in (0, 1) for p in range(parts)])
    return _tabled(paths.join(counts, "path", "left"), parts)


def _tabled(counted: DataFrame, parts: int) -> DataFrame:
    table = F.array(*[F.array(*[F.coalesce(f"n{r}{p}", F.lit(0)).cast("long") for p in range(parts)]) for r in (0, 1)])
    return counted.withColumn("table", table).drop(*[f"n{r}{p}" for r in (0, 1) for p in range(parts)])


def chi_square(cells: list[list[Column]]) -> Column:
    """Pearson's statistic without correction; cells of expectation 0 are skipped, an empty table has none."""
    rows = [sum(r[1:], r[0]) for r in cells]
    cols = [sum((r[j] for r in cells[1:]), cells[0][j]) for j in range(len(cells[0]))]
    total = sum(rows[1:], rows[0])
    parts = []
    for r, row in enumerate(cells):
        for c, cell in enumerate(row):
            expected = rows[r] * cols[c] / F.nullif(total, F.lit(0))
            parts.append(F.when(expected > 0, (cell - expected) * (cell - expected) / expected).otherwise(0.0))
    return F.when(total == 0, F.lit(None).cast("double")).otherwise(sum(parts[1:], parts[0]))


def chi_square_tail(x: float, freedom: int) -> float:
    """P(X >= x) of one number; chi_square_p() is the same on columns."""
    if x <= 0:
        return 1.0
    if freedom % 2:
        p, term, k = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 1
    else:
        p, term, k = math.exp(-x / 2), x / 2 * math.exp(-x / 2), 2
    while k < freedom:
        p += term
        k += 2
        term *= x / k
    return min(1.0, p)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of one table of two by two, over all tables of its margins; fisher_p() is the same on columns."""
    r, s, n = a + b, c + d, a + c
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    log_p = lambda x: choose(r, x) + choose(s, n - x) - choose(r + s, n)
    here = log_p(a)
    terms = [log_p(x) for x in range(max(0, n - s), min(r, n) + 1)]
    return min(1.0, sum(math.exp(t) for t in terms if t <= here + 1e-7))


def significance(paths: DataFrame | Statistics, partition: DataFrame, parts: int, method: str = "chi square", level: float = 0.05) -> DataFrame:
    """Paths with their table, p-value and whether it is at most ``level``; an empty table is never significant."""
    counted = contingency(paths, partition, parts)
    cells = [[F.col("table")[r][p].cast("double") for p in range(parts)] for r in (0, 1)]
    if method == "chi square":
        counted = counted.withColumn("chi_square", chi_square(cells)).withColumn("p", chi_square_p(F.col("chi_square"), parts - 1))
    elif method == "fisher" and parts == 2:
        counted = counted.withColumn("p", fisher_p(*[c for row in cells for c in row]))
    else:
        raise ValueError("methods are 'chi square', and 'fisher' for two parts")
    return counted.withColumn("significant", F.coalesce(F.col("p") <= level, F.lit(False)))


def result_table(paths: DataFrame | Statistics, partition: DataFrame, parts: int, names: list[str], level: float = 0.05) -> DataFrame:
    """Significant paths alone, with a column for each cell of their table."""
    found = significance(paths, partition, parts, level=level).filter("significant")
    cells = [F.col("table")[r][p].alias(f"{who}_{name}") for r, who in ((0, "part"), (1, "nonpart")) for p, name in enumerate(names)]
    return found.select("length", "frequency", "path", *cells, F.round("p", 9).alias("p"))
