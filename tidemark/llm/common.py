"""What the operators share: the shared folder, staged tables, joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.storage import Staging, not_broadcast, shared_dir

__all__ = ["Staging", "not_broadcast", "shared_dir"]

#: Words are runs of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot if it holds at least this share of all rows; so at most 1,000 keys are.
HOT_SHARE = 1000
#: Bits of the prefilter of ``semi_join``: 4 MiB, whatever the input's size.
FILTER_BITS = 1 << 25


def ascii_lower(c: Column) -> Column:
    """A-Z only in lower case. lower() does just that to ASCII text, and runs over bytes."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def locator(docs: DataFrame) -> Column:
    """File and row of the content where the rows come straight from files, else a number given on reading."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def located(docs: DataFrame) -> DataFrame:
    """The same rows with locators that last: rows that don't come straight from files are written first."""
    return docs if "_metadata" in str(locator(docs)) else Staging(docs.sparkSession, "input").table(docs, "docs")


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct, whatever its columns are named, beside its locator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), locator(docs).alias("_locator"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hot_safe_join(left: DataFrame, table: DataFrame, key: str, size: Column, total: int, how: str = "inner") -> DataFrame:
    """Joins the rows of ``left`` with their one row of ``table`` by ``key``.

    ``size`` says how many rows of ``left`` have the key, of ``total`` in all. Keys with a thousandth
    of the rows or more, so 1,000 at most, are broadcast and never shuffled; the others are small
    enough for a shuffled join. ``left`` should be a staged table: it is read twice.
    """
    hot = table.filter(size * HOT_SHARE >= total) if total else table.limit(0)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(table, key, how))


def _marked(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Adds _near: whether the key may be among ``ids``, by a bit map of their hashes that is broadcast (4 MiB at any size)."""
    h = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bits = ids.groupBy(F.bitmap_bucket_number(h).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("_bits"))
    at = F.bitmap_bit_position(h).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, _at) & 1 = 1")
    marked = df.withColumns({"_bucket": F.bitmap_bucket_number(h), "_at": at.bitwiseAND(7)}).join(F.broadcast(bits), "_bucket", "left")
    return marked.withColumn("_byte", byte).select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(bit, F.lit(False)).alias("_near"))


def may_match(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` that the bit map of the ids lets through: all whose key is among them, few others
    unless there are very many ids. A join that follows shuffles only these."""
    return _marked(df, ids, key).filter("_near").drop("_near")


def semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``ids`` (null: never)."""
    return may_match(df, ids, key).join(not_broadcast(ids.select(key)), key, "left_semi")


def anti_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among ``ids``; what the bit map excludes passes without a shuffle."""
    marked = _marked(df, ids, key)
    return marked.filter("not _near").drop("_near").unionByName(marked.filter("_near").drop("_near").join(not_broadcast(ids.select(key)), key, "left_anti").select(df.columns))


def text_groups(batch, size: int = 1 << 21):
    """A batch in slices whose second column holds about ``size`` bytes, or one longer value, so that what Python
    holds at once is bounded; 1,024 rows where it is no text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column, n = batch.column(1), batch.num_rows
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = (np.flatnonzero(np.diff(upto // size)) + 1).tolist()
    else:
        cuts = list(range(1024, n, 1024))
    for start, end in zip([0, *cuts], [*cuts, n], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


def map_texts(df: DataFrame, key: str, text: str, schema: str, rows, types) -> DataFrame:
    """``key`` and, from ``rows(texts)``, one tuple of new columns for each text of an Arrow batch; null is empty text."""
    import pyarrow as pa

    names = [key, *(x.split()[0] for x in schema.split(","))]

    def run(batches):
        for batch in batches:
            for part in text_groups(batch):
                columns = zip(*rows([t or "" for t in part.column(1).to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {schema}")


def sample_texts(docs: DataFrame, doc_id: str, text: str, most: int) -> DataFrame:
    """(id, text) of at most ``most`` rows, for training: of the ids that hash lowest, so any run takes the same; where
    rows share an id, their smallest text. Null texts are empty, null ids are left out."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("id is not null")
    ids = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(most).distinct()
    return rows.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def learn(sample: DataFrame, schema: str, tally) -> list[tuple]:
    """What ``tally(texts)`` counts in each of a few parts of a sample of texts, as tuples by the schema: texts stay on the executors."""
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        texts = [t for batch in batches for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in tally(texts)], schema=types)

    kinds = {"binary": pa.binary(), "double": pa.float64(), "long": pa.int64(), "string": pa.string()}
    types = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, schema.split(","), strict=True)])
    return [tuple(r) for r in sample.select("text").repartition(8).mapInArrow(run, schema).collect()]


def tallied(df: DataFrame, key: str, value: str, count) -> tuple:
    """Sums by cell, as two arrays, of the whole numbers that ``count(parts)`` gives as cells and numbers for each partition,
    from slices of its keys and values, as lists: all rows count, none comes to the driver. A sum is the same in any order."""
    import pyarrow as pa

    def run(batches):
        cells, n = count((part.column(0).to_pylist(), part.column(1).to_pylist()) for batch in batches for part in text_groups(batch))
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

    found = df.select(key, value).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return found["cell"].to_numpy(), found["n"].to_numpy()


def span_text(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """(start, kind's number, end) in order, as kind:start:end joined by commas."""
    return ",".join([f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)])
