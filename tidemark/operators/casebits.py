"""Sets of cases as bits: cases get dense numbers, and a set is rows (key, word, bits) of 64 cases each.

Cases are numbered in the order of their first events, so those of one event or path lie close together: a dense
set takes a row for 64 cases, a sparse one a row for each. Unions are bit_or, sections and differences bit operations of
rows with equal keys, sizes sums of bit_count: no set is gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import Staging

from .ranks import ranked


def numbered(log: DataFrame, stage: Staging | None = None) -> DataFrame:
    """(case_id, number) of all cases, from 0 on, by first event and case."""
    first = log.groupBy("case_id").agg(F.min("us").alias("us"))
    return ranked(first, [], ["us", "case_id"], stage=stage).select("case_id", F.col("before").alias("number"))


def as_words(rows: DataFrame, numbers: DataFrame, *keys: str) -> DataFrame:
    """(keys, word, bits) of rows (keys, case_id)."""
    hits = rows.join(numbers, "case_id").withColumns({"word": F.floor(F.col("number") / 64), "bit": F.expr("shiftleft(1L, cast(pmod(number, 64) as int))")})
    return hits.groupBy(*keys, "word").agg(F.bit_or("bit").alias("bits"))


def union(words: DataFrame, *keys: str) -> DataFrame:
    """The words of all sets of equal keys together."""
    return words.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def size(bits: str | Column = "bits") -> Column:
    """An aggregate: the cases in a set's words."""
    return F.coalesce(F.sum(F.bit_count(bits)), F.lit(0)).cast("long")


def sizes(words: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return words.groupBy(*keys).agg(size().alias(name))


def members(words: DataFrame, numbers: DataFrame) -> DataFrame:
    """Back to rows with case_id: for listings."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    each = words.withColumn("_bit", F.explode(bits)).withColumn("number", F.col("word") * 64 + F.col("_bit"))
    return each.drop("_bit", "word", "bits").join(numbers, "number").drop("number")
