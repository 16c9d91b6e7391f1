"""Exact dedup as stateful streaming: keyed state on disk, without expiry, keeps digest, identifier and locator.

Fingerprints (digest of the normalised text, doc_id, content locator) are written to a folder that a
Structured Streaming query reads; its state, in RocksDB, holds for each digest the largest doc_id,
that row's locator and the number of rows. A digest that is hit again is checked on full bytes: the hits'
texts are fetched by their locators, and of each group the smallest and the largest must be equal.

Given a ``state_dir`` in the shared folder, fingerprints and state stay there, and later calls add to the state
of earlier ones: keep_id and group_size are then over all calls so far, rows are those of this call. Hits on rows
of earlier calls are checked on full bytes where these are passed again as ``earlier``, else by SHA-256 alone. A call's rows are
written under the sum of their hashes: the same call again, as after a crash of the driver, counts its rows once if they come
straight from files, whose locators last.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays,
null being smallest, and of rows that repeat it the one with the largest locator, so one row of a group
is kept; an empty table gives an empty result; texts of any length are hashed and compared whole; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import Staging

from .common import anti_join, ascii_lower, documents, hot_safe_join, located, locator, may_match, packed

#: State lives on disk, and a store's local files go as soon as its task has committed them: each
#: store sets some megabytes aside, which adds up where one executor has served many of them.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Fingerprints read in one micro-batch, so that state grows by bounded steps.
BATCH_BYTES = 16 << 30


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def normal_text(c: Column) -> Column:
    return ascii_lower(F.coalesce(c, F.lit("")))


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = sha256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), digest(normal_text(F.col(text))).alias("digest"), locator(docs).alias("locator"))


def run_state(spark: SparkSession, base: str, prints: DataFrame, label: str = "prints", each: str = "") -> DataFrame:
    """Streams the fingerprints under ``base``/``label`` (and ``each``, a pattern of folders in it) into keyed state; returns digest, keeper (doc_id, locator), group_size.

    The state is the streaming query's own: RocksDB on the executors' disks, with change files in
    its checkpoint in the shared folder. Each batch writes the keys that it changed; as counts and
    keepers only grow, a digest's newest state is its largest.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(prints.schema)
            .option("maxBytesPerTrigger", BATCH_BYTES)
            .parquet(f"{base}/{label}{each}")
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size"))
        )

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/{label}-state/batch={number}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/{label}-checkpoint").foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if not _exists(spark, f"{base}/{label}-state"):
        return spark.createDataFrame([], state.schema)
    changes = spark.read.schema(state.schema).parquet(f"{base}/{label}-state")
    return changes.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size"))


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def collisions(texts: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests whose hits hold different texts. ``texts`` (locator, text) are fetched by the locators of ``hits``;
    one smallest and one largest for each task and digest are shuffled: a group of any size stays small."""
    found = may_match(texts, hits, "locator").select(digest(normal_text(F.col("text"))).alias("digest"), normal_text(F.col("text")).alias("_text"))
    return found.groupBy("digest").agg(F.min("_text").alias("a"), F.max("_text").alias("b")).filter("a <> b").select("digest")


def find(docs: DataFrame, digest: Callable[[Column], Column] = sha256, doc_id: str = "doc_id", text: str = "text", stage: Staging | None = None, state_dir: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, locator, digest, keep_id, group_size, kept, checked on full bytes."""
    spark, stage = docs.sparkSession, stage or Staging(docs.sparkSession, "dedup")
    docs = located(docs)
    prints = stage.table(fingerprints(docs, digest, doc_id, text), "prints")
    if state_dir:
        call = f"{state_dir}/prints/call-{_call_id(prints)}"
        if not _exists(spark, f"{call}/_SUCCESS"):
            prints.write.mode("overwrite").parquet(call)
    out = _joined(stage, prints, run_state(spark, state_dir or stage.base, prints, each="/call-*" if state_dir else ""), "joined")
    slim = lambda df: df.select(locator(df).alias("locator"), F.col(text).alias("text"))
    texts = slim(docs) if earlier is None else slim(docs).unionByName(slim(earlier))
    hits = out.filter("group_size > 1")
    hits = hits.select("locator").unionByName(hits.select("keeper.locator").distinct()) if earlier is not None else hits.select("locator")
    differ = stage.table(collisions(texts, hits, digest), "differ")
    if not differ.isEmpty():
        if state_dir:
            raise ValueError(f"texts of one digest differ; the state in {state_dir} needs a longer digest")
        # texts that share a digest but differ: the digest is joined by the text itself as key
        full = docs.select(F.col(doc_id).alias("doc_id"), digest(normal_text(F.col(text))).alias("digest"), locator(docs).alias("locator"), normal_text(F.col(text)).alias("_text"))
        full = full.join(differ.withColumn("_differs", F.lit(True)), "digest", "left")
        exact = F.when(F.col("_differs"), F.concat_ws(":", "digest", "_text")).otherwise(F.col("digest"))
        prints = stage.table(full.select("doc_id", exact.alias("digest"), "locator"), "exact")
        out = _joined(stage, prints, run_state(spark, stage.base, prints, "exact"), "exact-joined")
    same = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & F.col("locator").eqNullSafe(F.col("keeper.locator"))
    return out.select("doc_id", "locator", F.substring("digest", 1, 64).alias("digest"), F.col("keeper.doc_id").alias("keep_id"), "group_size", same.alias("kept"))


def _call_id(prints: DataFrame) -> str:
    """The rows' number and the sum of their hashes: the same for the same rows in any order."""
    h = F.xxhash64("doc_id", "digest", "locator").cast("decimal(20,0)")
    n, total = prints.agg(F.count("*"), F.sum(h)).first()
    return f"{n}-{total or 0}"


def _joined(stage: Staging, prints: DataFrame, groups: DataFrame, label: str) -> DataFrame:
    """Each fingerprint with its group."""
    groups = stage.table(groups, f"{label}-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    return stage.table(hot_safe_join(prints, groups, "digest", F.col("group_size"), total), label)


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, in the input's columns: rows of files are found again by their locator."""
    docs, stage = located(docs), Staging(docs.sparkSession, "dedup")
    gone = find(docs, doc_id=doc_id, text=text, stage=stage).filter("not kept").select(F.col("locator").alias("_locator"))
    gone = Staging(docs.sparkSession, "dropped").table(gone, "rows")
    stage.drop()
    return anti_join(packed(docs), gone, "_locator").select("_row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
