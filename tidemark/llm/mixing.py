"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

A token budget goes down the tree: children share their parent's budget by weight, none gets more than
its documents hold in ``max_epochs`` passes, and what one cannot take goes to its siblings by weight
(a water level, from running sums over the children by capacity per weight). As a parent never gets
more than its subtree holds, shortages reach ancestors only when all siblings are full. A leaf's
budget buys whole epochs and then a token-prefix of one more, whose order is the MD5 of seed, epoch
and doc_id.

Tokens are words (runs of characters other than ASCII white space) unless ``tokens`` gives another count, such as
that of a tokenizer. Children of one parent are laid out in one task, a row of some numbers each.

The prefix of a leaf of any size is found by sums over 65,536 ranges of that order; only the range in
which the budget ends is looked at row by row. Defined results: null in a tree column is the child
"null"; null text has no tokens; documents without tokens cost nothing; equal keys are ordered by doc_id
and row; repeated rows count each; an empty table gives an empty result; whole texts of any length are counted;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.storage import Staging

from .common import anti_join, documents, hot_safe_join, located, locator, may_match, not_broadcast, packed, words

#: Weights of the query and the pipeline by path; children that are not named weigh 1.
WEIGHTS = {"domain0": 4.0, "domain1": 2.0, "domain0/en": 3.0, "domain0/de": 2.0, "domain1/en": 2.0, "domain2/en": 2.0, "domain3/fr": 2.0}
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.8, 2, 17
_RANGE = 4  # hex digits of the order that number its ranges


def domain_of(source: Column) -> Column:
    """One of four domains for each source, by its MD5."""
    return F.concat(F.lit("domain"), F.translate(F.substring(F.md5(F.coalesce(source, F.lit("null")).cast("binary")), 1, 1), "0123456789abcdef", "0123" * 4))


def share_out(nodes: DataFrame, parent: str) -> DataFrame:
    """Adds ``budget`` to nodes (path, parent's path and budget, capacity, weight): the water level of each family."""
    family = Window.partitionBy(parent).orderBy(F.col("capacity") / F.col("weight"), "path")
    before = F.coalesce(F.sum("capacity").over(family.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # what is left of the family's weight, without a frame that each row would sum anew
    weight = F.sum("weight").over(Window.partitionBy(parent)) - F.coalesce(F.sum("weight").over(family.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("parent_budget") - before) / weight
    nodes = nodes.withColumn("_level", level)
    open_level = F.first(F.when(F.col("capacity") > F.col("weight") * F.col("_level"), F.col("_level")), ignorenulls=True).over(family.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nodes = nodes.withColumn("_open", open_level)
    return nodes.withColumn("budget", F.when(F.col("_open").isNull(), F.col("capacity").cast("double")).otherwise(F.least(F.col("capacity").cast("double"), F.col("weight") * F.col("_open")))).drop("_level", "_open")


def budgets(leaves: DataFrame, budget: float, weights: dict[str, float]) -> DataFrame:
    """Leaves (p1, p2, p3 paths, n_docs, tokens, capacity) with their budgets in tokens, from the root's."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    weight = F.coalesce(F.create_map(*pairs)[F.col("path")], F.lit(1.0)) if pairs else F.lit(1.0)
    above = None
    for depth in (1, 2, 3):
        path, parent = f"p{depth}", f"p{depth - 1}"
        ups = [f"p{i}" for i in range(1, depth)]
        nodes = leaves.groupBy(path, *ups).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"), F.sum("n_docs").alias("n_docs")).withColumn("path", F.col(path)).withColumn("weight", weight)
        nodes = nodes.withColumn(parent, F.lit("")).withColumn("parent_budget", F.lit(float(budget))) if above is None else nodes.join(above, parent)
        above = share_out(nodes, parent)
        if depth < 3:
            above = above.select(path, F.col("budget").alias("parent_budget"))
    return above.select("path", "n_docs", "tokens", "capacity", "weight", F.floor("budget").alias("budget"))


def mix(docs: DataFrame, tree: tuple[Column, Column, Column] | None = None, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, weights: dict[str, float] | None = None, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", stage: Staging | None = None, tokens: Column | None = None) -> DataFrame:
    """One row for each document and epoch that is chosen: doc_id, locator, path, epoch, n_tokens.

    The budget is ``budget_share`` of all tokens. ``tree`` gives the three levels' columns, by default
    a domain of the source, lang and source.
    """
    stage = stage or Staging(docs.sparkSession, "mixing")
    weights = WEIGHTS if weights is None else weights
    levels = tree or (domain_of(F.col("source")), F.col("lang"), F.col("source"))
    name = [F.coalesce(c.cast("string"), F.lit("null")) for c in levels]
    count = F.size(words(F.coalesce(F.col(text), F.lit("")))) if tokens is None else F.coalesce(tokens, F.lit(0))
    slim = docs.select(F.col(doc_id).alias("doc_id"), locator(docs).alias("locator"), *[F.concat_ws("/", *name[:i]).alias(f"p{i}") for i in (1, 2, 3)], count.cast("long").alias("n_tokens"))
    slim = stage.table(slim, "slim")
    leaves = stage.table(slim.groupBy("p1", "p2", "p3").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * max_epochs), "leaves")
    total, n = leaves.agg(F.sum("tokens"), F.sum("n_docs")).first()
    total, n = total or 0, n or 0
    plan = stage.table(budgets(leaves, min(total * budget_share, total * max_epochs), weights).withColumnRenamed("path", "p3"), "budgets")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    plan = plan.select("p3", "n_docs", whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    keyed = hot_safe_join(slim.select("doc_id", "locator", "p3", "n_tokens"), plan, "p3", F.col("n_docs"), n).withColumn("_order", order).withColumn("_range", F.substring("_order", 1, _RANGE))
    keyed = stage.table(keyed, "keyed")
    ranges = keyed.groupBy("p3", "_range").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    ranges = ranges.withColumn("upto", F.sum("t").over(Window.partitionBy("p3").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ranges.filter("upto > rest").groupBy("p3").agg(F.min(F.struct("_range", (F.col("upto") - F.col("t")).alias("before"))).alias("end"))
    ends = stage.table(plan.select("p3", F.col("n_docs").alias("_n")).join(ends, "p3", "left"), "ends")
    placed = hot_safe_join(keyed, ends, "p3", F.col("_n"), n)
    inside = F.col("end").isNull() | (F.col("_range") < F.col("end._range"))
    at_end = placed.filter(F.col("_range") == F.col("end._range"))
    running = F.col("end.before") + F.sum("n_tokens").over(Window.partitionBy("p3", "_range").orderBy("_order", "doc_id", "locator").rowsBetween(Window.unboundedPreceding, 0))
    last = placed.filter(inside).drop("end", "_n").unionByName(at_end.withColumn("_upto", running).filter("_upto <= rest").drop("_upto", "end", "_n"))
    epochs = keyed.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    cols = ["doc_id", "locator", F.col("p3").alias("path"), "epoch", "n_tokens"]
    # a leaf whose budget is spent by whole epochs has no other one to begin
    last = last.filter("rest > 0 or whole = 0").withColumn("epoch", F.col("whole"))
    return epochs.select(*cols).unionByName(last.select(*cols))


def keep(docs: DataFrame, budget_share: float = 0.9, max_epochs: int = 1, **more) -> DataFrame:
    """The chosen documents in the input's columns, once for each epoch.

    Text is not shuffled for rows that are chosen once: those that are not chosen are taken out, and those
    of several epochs, found by the bit map of their locators, are added again.
    """
    docs, stage = located(docs), Staging(docs.sparkSession, "mixing")
    times = mix(docs, budget_share=budget_share, max_epochs=max_epochs, stage=stage, **more).groupBy(F.col("locator").alias("_locator")).agg(F.count("*").alias("_times"))
    kept = Staging(docs.sparkSession, "mixed")
    times = kept.table(times, "times")
    gone = kept.table(docs.select(locator(docs).alias("_locator")).join(not_broadcast(times), "_locator", "left_anti"), "gone")
    again = kept.table(times.filter("_times > 1"), "again")
    stage.drop()
    rows = packed(docs)
    extra = may_match(rows, again, "_locator").join(not_broadcast(again), "_locator").select("_row", F.explode(F.sequence(F.lit(2), F.col("_times").cast("int"))))
    return anti_join(rows, gone, "_locator").select("_row.*").unionByName(extra.select("_row.*"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mix(documents(spark, sf_dir))
    return chosen.select("doc_id", "path", F.col("epoch").cast("int").alias("epoch"), "n_tokens")


_LEVEL = """
{name} AS (SELECT *, CASE WHEN open_level IS NULL THEN CAST(capacity AS DOUBLE) ELSE least(CAST(capacity AS DOUBLE), weight * open_level) END AS budget FROM (
  SELECT *, first_value(CASE WHEN capacity > weight * lvl THEN lvl END IGNORE NULLS) OVER (PARTITION BY parent ORDER BY capacity / weight, path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS open_level FROM (
    SELECT *, (parent_budget - coalesce(sum(capacity) OVER (PARTITION BY parent ORDER BY capacity / weight, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (PARTITION BY parent ORDER BY capacity / weight, path ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM (
      SELECT l.{col} AS path, {parent} AS parent, {up} AS parent_budget, coalesce(any_value(w.weight), 1.0) AS weight, sum(l.capacity) AS capacity, sum(l.tokens) AS tokens
      FROM leaves l LEFT JOIN weights w ON w.path = l.{col} {join} GROUP BY ALL))))"""

ORACLE = (
    "WITH weights(path, weight) AS (VALUES "
    + ", ".join(f"('{p}', CAST({w} AS DOUBLE))" for p, w in WEIGHTS.items())
    + r"""),
named AS (SELECT doc_id, 'domain' || translate(substr(md5(coalesce(source, 'null')), 1, 1), '0123456789abcdef', '0123012301230123') AS d, coalesce(lang, 'null') AS l, coalesce(source, 'null') AS s,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
slim AS (SELECT doc_id, d AS p1, d || '/' || l AS p2, d || '/' || l || '/' || s AS p3, n_tokens FROM named),
leaves AS (SELECT p1, p2, p3, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * """
    + str(MAX_EPOCHS)
    + " AS BIGINT) AS capacity FROM slim GROUP BY ALL),"
    + _LEVEL.format(name="l1", col="p1", parent="''", up=f"(SELECT CAST(sum(tokens) AS DOUBLE) * {BUDGET_SHARE} FROM leaves)", join="")
    + ","
    + _LEVEL.format(name="l2", col="p2", parent="l.p1", up="any_value(u.budget)", join="JOIN l1 u ON u.path = l.p1")
    + ","
    + _LEVEL.format(name="l3", col="p3", parent="l.p2", up="any_value(u.budget)", join="JOIN l2 u ON u.path = l.p2")
    + f""",
plan AS (SELECT path AS p3, CASE WHEN tokens > 0 THEN CAST(floor(floor(budget) / tokens) AS INTEGER) ELSE 0 END AS whole, floor(budget) AS b, tokens FROM l3),
keyed AS (SELECT s.*, p.whole, p.b - p.whole * p.tokens AS rest, md5('{SEED}:' || p.whole || ':' || s.doc_id) AS o FROM slim s JOIN plan p ON s.p3 = p.p3),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY p3 ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)
SELECT doc_id, p3 AS path, CAST(whole AS INTEGER) AS epoch, n_tokens FROM run WHERE upto <= rest AND (rest > 0 OR whole = 0)
UNION ALL SELECT doc_id, p3 AS path, CAST(e.e AS INTEGER) AS epoch, n_tokens FROM keyed JOIN (SELECT unnest(range(0, {MAX_EPOCHS + 1})) AS e) e ON e.e < whole"""
)
