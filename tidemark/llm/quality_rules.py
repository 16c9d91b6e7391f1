"""Host-level quality rules: rule failures by domain, shrunk by an empirical beta prior, decide on documents.

Every document gets the base counts and points for soft rules: one for a limit that it breaks, two beyond
twice that limit, three beyond four times. Failures (of the base or any soft rule) are summed by host (the
column ``source``), the hosts' failure rates shrink towards a beta prior that is fitted to all hosts by moments,
and each host's verdict goes back to its documents. With a chance of nine tenths, by its posterior, a host is

- rejected if more than nine tenths of its documents fail: all of them go;
- suspect if its rate lies more than one deviation of the prior above the prior's mean: one point is enough to go;
- trusted if it lies as far below the mean: only documents of three points go;
- ordinary else: documents of two points go.

Chances are taken from the normal curve of the posterior's mean and variance. Documents that fail the base go anywhere.

Defined results: null text has no words and fails; a null source is a host of its own; an empty table gives
an empty result; repeated rows stay and count each; ties (a rate on a limit) count as ordinary; texts of any length
are counted whole, in memory proportional to their words; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import Staging

from .common import SPACE, anti_join, documents, hot_safe_join, located, locator, packed, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Soft rules: symbols to a hundred words, percent of repeated lines, mean length of words.
SYMBOLS_PERCENT, LINES_PERCENT, WORD_LENGTHS = 10, 30, (2, 10)
#: Least points at which a document goes, by its host's verdict.
POINTS = {"suspect": 1, "ordinary": 2, "trusted": 3}
#: Rate of a rejected host, deviations of the prior that set hosts apart, and those of a chance of nine tenths.
REJECT_RATE, APART, SURE = 0.9, 1.0, 1.2816
#: Room for the position in a sorted key; the other 33 bits hold a hash.
_POSITION = 31


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: how many of ``_words`` stand in a 3-word window that occurs twice or more.

    Texts whose windows all hash apart have none. In the others, sorting primitive keys (33 bits of
    the hash above the position) brings equal windows together; neighbours of equal hash are compared
    as words, and should one pair differ, all of these windows are sorted as words: the count is exact.
    Each step is a column of its own, as a lambda would evaluate an inlined array for each element.
    """
    w, last = F.col("_words"), F.size("_words") - 3
    none = F.array().cast("array<bigint>")
    mask = lambda bits: F.lit((1 << bits) - 1).cast("long")
    part = lambda k: F.shiftright(k, _POSITION)
    at = lambda k: k.bitwiseAND(mask(_POSITION)).cast("int")
    # get() outside of the array is null, and a null comparison leaves the decision to the other one
    meets = lambda a, f: F.filter(a, lambda x, i: (f(F.get(a, i - 1)) == f(x)) | (f(F.get(a, i + 1)) == f(x)))
    window = lambda k: F.array_join(F.slice(w, at(k) + 1, F.lit(3)), " ")
    word = lambda k, j: F.get(w, at(k) + j)
    differ = lambda x, y: (part(x) == part(y)) & ~((word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2)))
    df = df.withColumn("_hash", F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(none))
    keys = F.sort_array(F.transform("_hash", lambda h, i: F.shiftleft(h.bitwiseAND(mask(33)), _POSITION).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_keys", F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), keys).otherwise(none))
    df = df.withColumn("_near", meets(F.col("_keys"), part))
    df = df.withColumn("_mixed", F.exists(F.transform("_near", lambda k, i: differ(k, F.coalesce(F.get(F.col("_near"), i - 1), k))), lambda x: x))
    df = df.withColumn("_found", F.when(F.col("_mixed"), F.sort_array(F.transform("_near", lambda k: F.struct(window(k).alias("w"), k.alias("k"))))))
    df = df.withColumn("_same", F.when(F.col("_mixed"), F.transform(meets(F.col("_found"), lambda x: x["w"]), lambda x: x["k"])).otherwise(F.col("_near")))
    covered = F.flatten(F.transform("_same", lambda k: F.array(at(k), at(k) + 1, at(k) + 2)))
    return df.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).drop("_hash", "_keys", "_near", "_mixed", "_found", "_same")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with its counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) and rules."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.when(t.rlike(f"[{SYMBOLS}]"), F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).otherwise(0)
    out = _with_repeat_words(docs.withColumns({"_words": words(t), "_lines": lines}))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_words", "_lines")
    n, chars = F.col("n_words"), F.col("word_chars")

    def points(breaks) -> Column:
        return sum((breaks(f).cast("int") for f in (2, 4)), breaks(1).cast("int"))

    rules = (
        lambda f: 100 * F.col("n_symbols") > SYMBOLS_PERCENT * f * n,
        lambda f: 100 * F.col("n_dup_lines") > LINES_PERCENT * f * F.col("n_lines"),
        lambda f: (f * chars < WORD_LENGTHS[0] * n) | (chars > WORD_LENGTHS[1] * f * n),
    )
    out = out.withColumns({"base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n), "soft_points": F.greatest(*map(points, rules))})
    return out.withColumn("soft_failed", F.col("soft_points") > 0)


def hosts(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: n_docs, n_failed, its shrunk rate and verdict.

    The prior Beta(a, b) has the mean of all documents and the variance of the hosts' rates beyond
    what chance explains; where there is none, it is as strong as the hosts' mean size. Four sums
    over the hosts come to the driver, never the hosts.
    """
    counts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m, v, inverse, mean_size = counts.agg(F.sum("n_failed") / F.sum("n_docs"), F.var_pop(rate), F.avg(1 / F.col("n_docs")), F.avg("n_docs")).first()
    if m is None:
        m, strength = 0.0, 2.0
    else:
        between = v - m * (1 - m) * inverse
        strength = max(2.0, m * (1 - m) / between - 1 if between > 0 else mean_size)
    spread = APART * math.sqrt(m * (1 - m) / (strength + 1))
    counts = counts.withColumn("shrunk_rate", (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength)))
    shrunk = F.col("shrunk_rate")
    unsure = SURE * F.sqrt(shrunk * (1 - shrunk) / (F.col("n_docs") + F.lit(strength + 1)))
    verdict = F.when(shrunk - unsure > REJECT_RATE, "rejected").when(shrunk - unsure > F.lit(m + spread), "suspect").when(shrunk + unsure < F.lit(m - spread), "trusted")
    return counts.withColumn("verdict", verdict.otherwise("ordinary"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", stage: Staging | None = None) -> DataFrame:
    """The input's rows and columns but for the text, with all counts, shrunk_rate, host_verdict and kept.

    Columns of the input that are named like results are replaced. The measures are staged without
    the text; text is never shuffled.
    """
    stage = stage or Staging(docs.sparkSession, "rules")
    slim = stage.table(measure(docs, text).withColumn("_host", _host(F.col(host))).drop(text), "measured")
    verdicts = stage.table(hosts(slim, "_host"), "hosts").select(F.col("host").alias("_host"), F.col("n_docs").alias("_n"), F.col("shrunk_rate"), F.col("verdict").alias("host_verdict"))
    total = verdicts.agg(F.sum("_n")).first()[0] or 0
    out = hot_safe_join(slim.drop("shrunk_rate", "host_verdict"), verdicts, "_host", F.col("_n"), total)
    return out.withColumn("kept", _kept(F.col("host_verdict"))).drop("_host", "_n")


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, in their own columns, whatever these are named. Rows are judged without
    their text, and those that go are taken out by locator."""
    docs, stage = located(docs), Staging(docs.sparkSession, "rules")
    rows = docs.select(locator(docs).alias("_locator"), F.col(text).alias("text"), F.col(host).alias("source"))
    gone = judge(rows, stage=stage).filter("not kept").select("_locator")
    gone = Staging(docs.sparkSession, "dropped").table(gone, "rows")
    stage.drop()
    return anti_join(packed(docs), gone, "_locator").select("_row.*")


def _host(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), c.cast("string")), F.lit("null"))


def _kept(verdict: Column) -> Column:
    points = F.col("soft_points")
    stays = [(verdict == name) & (points < least) for name, least in POINTS.items()]
    return ~F.col("base_failed") & (stays[0] | stays[1] | stays[2])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_points", "host_verdict", F.round("shrunk_rate", 6).alias("host_rate"))
