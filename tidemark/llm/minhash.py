"""MinHash near-dedup: universal hash minima with banding, verification, connected components.

1. Every document's distinct word shingles are hashed to 64 bits; many universal hash functions give
   its minima, cut into bands. Documents with equal sets form one class, with a number of its own (rid) and one
   representative row; repeated rows and rows of one doc_id with several texts are no special case from there on.
2. Representatives with an equal band are candidates. A bucket is not expanded into pairs: each member
   gets an edge to the bucket's smallest, and the components of these edges are groups outside of which
   nothing can be linked by a band.
3. Groups are resolved exactly, in blocks of bounded size: signatures leave out pairs that cannot reach
   the similarity, the others are compared on their full sets. A pair is passed over only if its two
   documents are connected already. Of a group of several blocks, each block is resolved alone, then
   against one lead block. What is left are buckets whose members belong to different components: there
   each member outside of the bucket's largest component is compared with all members of the bucket, in
   blocks again, so every pair that shares a band is compared or connected.
4. The links' components, found by large-star and small-star, give each document its smallest partner.

The number of bands is chosen so that a pair at the similarity itself is missed with a probability under
1e-5. Defined results: null text is empty; documents without words have an empty set and stay alone;
with fewer words than a shingle has, all words are one shingle; repeated rows share their fate, and rows
that share a doc_id but not their text are judged each by its own; a null doc_id stays alone with a null
component and is kept; an empty table gives an empty result; whole texts of any length are read, a block's
memory growing with its longest; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.components import connected
from tidemark.storage import Staging

from .common import anti_join, documents, hot_safe_join, located, locator, map_texts, may_match, not_broadcast, packed

HASHES, MISS = 256, 1e-5
#: A block has this many documents, or shingles, on average at most.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
#: Standard deviations by which a signature may fall short of the similarity.
SIGMAS = 6
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class WordHashes(dict):
    """Words' 64-bit hashes, each computed once while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def shingles(text: str, k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles. bytes.lower() and split() know ASCII alone."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(k, len(h))
    if not n:
        return h
    at = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        at = _mix(at * _M[i % len(_M)] + h[i : len(h) - n + 1 + i])
    return np.unique(at)


def bands_and_rows(percent: int) -> tuple[int, int]:
    """The most rows a band may have, and as many bands as HASHES allow."""
    t = percent / 100
    rows = max(r for r in range(1, 17) if (1 - t**r) ** (HASHES // r) <= MISS)
    return HASHES // rows, rows


class Signer:
    def __init__(self, percent: int):
        self.bands, self.rows = bands_and_rows(percent)
        rng = np.random.default_rng(20240229)
        n = self.bands * self.rows
        self.a, self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.weights = rng.integers(0, 1 << 63, self.rows, dtype=np.uint64) | np.uint64(1)
        self.start = rng.integers(0, 1 << 63, self.bands, dtype=np.uint64)

    def minima(self, s: np.ndarray) -> np.ndarray:
        """Of a * x + b modulo 2**32, for each function."""
        low = (s >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(low), 512):
            best = np.minimum(best, (low[at : at + 512, None] * self.a + self.b).min(axis=0))
        return best

    def keys(self, minima: np.ndarray) -> np.ndarray:
        parts = minima.reshape(self.bands, self.rows).astype(np.uint64)
        return _mix((parts * self.weights).sum(axis=1, dtype=np.uint64) + self.start).view(np.int64)


def sign(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, the set's digest, the signature's low bytes and the bands' keys."""

    def rows(texts: list[str]) -> Iterator[tuple]:
        signer, known = Signer(percent), WordHashes()
        for t in texts:
            s = shingles(t, k, known)
            if len(s):
                m = signer.minima(s)
                yield len(s), xxhash.xxh3_128_digest(s.tobytes()), m.astype(np.uint8).tobytes(), signer.keys(m)
            else:
                yield 0, None, None, None

    return map_texts(docs, doc_id, text, "n_shingles long, digest binary, signature binary, bands array<bigint>", rows, [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())])


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(key, text) to (key, shingles): the sorted hashes as bytes."""

    def rows(texts: list[str]) -> Iterator[tuple]:
        known = WordHashes()
        return ((shingles(t, k, known).tobytes(),) for t in texts)

    return map_texts(docs, "key", "text", "shingles binary", rows, [pa.binary()])


class Block:
    """The documents of a block, and which of them are connected by now (equal ``label``)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, signatures: list[bytes], sets: list[bytes], percent: int):
        self.ids, self.percent = ids, percent
        self.label = np.unique(labels, return_inverse=True)[1]
        self.signature = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(ids), -1)
        arrays = [np.frombuffer(s, np.uint64) for s in sets]
        self.size = np.array([len(a) for a in arrays])
        values, number = np.unique(np.concatenate(arrays), return_inverse=True)
        self.mark, ends = np.zeros(len(values), dtype=np.int32), np.cumsum(self.size)
        self.tokens = [number[e - n : e] for e, n in zip(ends, self.size, strict=True)]
        t, n = percent / 100, self.signature.shape[1]
        self.agree = n * max(0.0, t - SIGMAS * math.sqrt(t * (1 - t) / n))

    def link(self, q: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Compares ``q`` with those of ``others`` that it isn't connected with, and connects; one link for each two components."""
        n = self.size[q]
        others = others[self.label[others] != self.label[q]]
        others = others[100 * np.minimum(self.size[others], n) >= self.percent * np.maximum(self.size[others], n)]
        if len(others):
            others = others[(self.signature[others] == self.signature[q]).sum(axis=1) >= self.agree]
        if not len(others):
            return []
        self.mark[self.tokens[q]] = 1
        starts = np.concatenate([[0], np.cumsum(self.size[others])[:-1]])
        common = np.add.reduceat(self.mark[np.concatenate([self.tokens[o] for o in others])], starts)
        self.mark[self.tokens[q]] = 0
        found = []
        for o in others[100 * common >= self.percent * (n + self.size[others] - common)]:
            if self.label[o] != self.label[q]:
                self.label[self.label == self.label[o]] = self.label[q]
                found.append((int(self.ids[q]), int(self.ids[o])))
        return found

    def within(self) -> list[tuple[int, int]]:
        """Links that connect all that is connected: ends when what was not compared yet is one component."""
        found, left = [], np.ones(len(self.ids), dtype=bool)
        everyone = np.arange(len(self.ids))
        while left.any():
            open_ = everyone[left]
            labels, counts = np.unique(self.label[open_], return_counts=True)
            if len(labels) == 1:
                break
            largest = labels[counts.argmax()]
            q = open_[self.label[open_] != largest][0] if counts.max() > 1 else open_[0]
            left[q] = False
            found += self.link(q, everyone)
        return found

    def across(self, asks: np.ndarray) -> list[tuple[int, int]]:
        """Links between those that ask and the others."""
        answers = np.flatnonzero(~asks)
        return [x for q in np.flatnonzero(asks) for x in self.link(q, answers)]


def resolve(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (u, v) of each block. ``members``: the keys, rid, label, asks, signature, shingles. Where some ask, they are
    linked with the others; else all are linked, each with the smallest that it is connected with in its block."""

    def links(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(parts)
        asks = t["asks"].to_numpy(zero_copy_only=False)
        block = Block(t["rid"].to_numpy(), t["label"].to_numpy(), t["signature"].to_pylist(), t["shingles"].to_pylist(), percent)
        if asks.any():
            return block.across(asks)
        block.within()
        least: dict[int, int] = {}
        for rid, label in sorted(zip(block.ids.tolist(), block.label.tolist(), strict=True)):
            least.setdefault(label, rid)
        return [(rid, least[label]) for rid, label in zip(block.ids.tolist(), block.label.tolist(), strict=True) if rid != least[label]]

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            ids = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True))
            at = 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and ids[end] == ids[at]:
                    end += 1
                if held and ids[at] != last:
                    yield batch(links(held))
                    held = []
                held.append(b.slice(at, end - at))
                last, at = ids[at], end
        if held:
            yield batch(links(held))

    ordered = members.select(*keys, "rid", "label", "asks", "signature", "shingles")
    return ordered.repartition(*keys).sortWithinPartitions(*keys, "rid").mapInArrow(run, "u bigint, v bigint")


def find(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", stage: Staging | None = None) -> DataFrame:
    """One row per document: doc_id, locator, n_shingles, component_id (the smallest doc_id it is connected with), kept."""
    stage = stage or Staging(docs.sparkSession, "minhash")
    docs = located(docs)
    docs = docs.select(F.struct(F.col(doc_id).cast("long").alias("doc_id"), locator(docs).alias("locator")).alias("row"), F.col(text).alias("text"))
    signed = stage.table(sign(docs, k, percent, "row", "text").select("row.*", "n_shingles", "digest", "signature", "bands"), "signed")
    usable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    first = F.min(F.struct("doc_id", "locator", "n_shingles", "signature", "bands"))
    classes = signed.filter(usable).groupBy("digest").agg(first.alias("rep"), F.count("*").alias("copies"))
    # numbers of the classes hold from here on, as the table is written
    classes = stage.table(classes.select("digest", "copies", "rep.*", F.monotonically_increasing_id().alias("rid")), "classes")
    links = _links(stage, docs, classes.select("rid", "locator", "n_shingles", "signature", "bands"), k, percent)
    names = classes.select("digest", "copies", F.col("doc_id").alias("component"))
    if links is not None:
        parts = stage.table(connected(stage, links, "components").select(F.col("node").alias("rid"), F.col("component").alias("part")), "result")
        member = stage.table(classes.select("rid", "doc_id").join(parts, "rid"), "parts")
        least = stage.table(member.groupBy("part").agg(F.min("doc_id").alias("component"), F.count("*").alias("size")), "least")
        named = hot_safe_join(member, least, "part", F.col("size"), member.count()).select("rid", "component")
        names = classes.select("rid", "digest", "copies", "doc_id").join(named, "rid", "left")
        names = stage.table(names.select("digest", "copies", F.coalesce("component", "doc_id").alias("component")), "labelled")
    slim = signed.select("doc_id", "locator", "n_shingles", "digest")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    linked = hot_safe_join(slim.filter(usable), names, "digest", F.col("copies"), total)
    out = linked.select("doc_id", "locator", "n_shingles", "component").unionByName(slim.filter(~usable).select("doc_id", "locator", "n_shingles", F.col("doc_id").alias("component")))
    return out.select("doc_id", "locator", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def _links(stage: Staging, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Verified links (u, v) between representatives that connect all that bands bring together."""
    banded = reps.select("rid", F.explode("bands").alias("band"))
    buckets = stage.table(banded.groupBy("band").agg(F.min("rid").alias("first"), F.count("*").alias("members")).filter("members > 1"), "buckets")
    total = reps.agg(F.sum(F.size("bands"))).first()[0] or 0
    edges = hot_safe_join(banded, buckets, "band", F.col("members"), total).filter("rid <> first").select(F.col("rid").alias("u"), F.col("first").alias("v"))
    groups = stage.table(connected(stage, edges, "groups").select(F.col("node").alias("rid"), F.col("component").alias("gid")), "grouped")
    if groups.isEmpty():
        return None
    sizes = stage.table(reps.select("rid", "locator", "n_shingles").join(groups, "rid"), "members")
    shape = stage.table(sizes.groupBy("gid").agg(F.count("*").alias("size"), _blocks(F.count("*"), F.sum("n_shingles")).alias("blocks")), "shape")
    n = shape.agg(F.sum("size")).first()[0]
    placed = hot_safe_join(sizes, shape, "gid", F.col("size"), n).withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    placed = stage.table(placed.select("rid", "locator", "gid", "blk", "blocks"), "placed")
    texts = may_match(docs.select(F.col("row.locator").alias("locator"), "text"), placed, "locator").join(not_broadcast(placed.select("locator", "rid")), "locator")
    sets = full_sets(texts.select(F.col("rid").alias("key"), "text"), k).withColumnRenamed("key", "rid")
    member = placed.drop("locator").join(reps.select("rid", "n_shingles", "signature"), "rid").join(sets, "rid")
    member = stage.table(member.select("gid", "blk", "blocks", "rid", "n_shingles", "signature", "shingles"), "sets")
    plain = member.withColumns({"label": F.col("rid"), "asks": F.lit(False)})
    found = stage.table(resolve(plain, ["gid", "blk"], percent), "links-1")
    large = member.filter("blocks > 1")
    if shape.filter("blocks > 1").isEmpty():
        return found
    others = F.sequence(F.lit(1), F.col("blocks") - 1)
    marked = _labelled(stage, large, found.select(F.col("u").alias("rid"), F.col("v").alias("label")), "one")
    lead = marked.filter("blk = 0").withColumn("blk", F.explode(others)).withColumn("asks", F.lit(True))
    more = stage.table(resolve(marked.filter("blk > 0").unionByName(lead), ["gid", "blk"], percent), "links-2")
    found = found.unionByName(more)
    # only blocks' links can meet those of the lead: links of groups of one block need no further look
    joint = found.join(large.select(F.col("rid").alias("u")).distinct(), "u", "left_semi").select("u", "v")
    marked = _labelled(stage, large, connected(stage, joint, "two").select(F.col("node").alias("rid"), F.col("component").alias("label")), "two")
    return found.unionByName(_bucket_links(stage, marked, banded, percent))


def _blocks(members: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(members / BLOCK_DOCS, shingles / BLOCK_SHINGLES)).cast("int")


def _bucket_links(stage: Staging, marked: DataFrame, banded: DataFrame, percent: int) -> DataFrame:
    """Links within buckets whose members have different labels: those outside of the bucket's largest label against all."""
    at = stage.table(marked.select("rid", "label", "n_shingles").join(banded, "rid"), "at")
    # the label that most members have is counted by band and label, so that a large bucket is no large group
    by = at.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    buckets = by.groupBy("band").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("size"), F.sum("s").alias("shingles")).filter("size > top.c")
    parts = F.ceil((F.col("size") - F.col("top.c")) / BLOCK_DOCS).cast("int")
    buckets = stage.table(buckets.select("band", "size", F.col("top.label").alias("top"), _blocks(F.col("size"), F.col("shingles")).alias("blocks"), parts.alias("parts")), "mixed")
    total = buckets.agg(F.sum("size")).first()[0] or 0
    mixed = hot_safe_join(at.select("rid", "label", "band"), buckets, "band", F.col("size"), total)
    mixed = stage.table(mixed.select("rid", "band", "top", "blocks", "parts"), "asked")
    rows = marked.select("rid", "label", "asks", "signature", "shingles").join(mixed, "rid").withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    answers = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asks = rows.filter("label <> top").withColumn("part", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("parts")).cast("int"))
    asks = asks.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    return stage.table(resolve(answers.unionByName(asks), ["band", "blk", "part"], percent), "links-3")


def _labelled(stage: Staging, member: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """Adds each member's component, ``parts`` (rid, label), or itself where it has none."""
    out = member.join(parts, "rid", "left").withColumn("label", F.coalesce("label", "rid")).withColumn("asks", F.lit(False))
    return stage.table(out, f"{name}-marked")


def keep(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows without those that are not kept: the rows of each component's smallest doc_id stay."""
    docs, stage = located(docs), Staging(docs.sparkSession, "minhash")
    gone = find(docs, k, percent, doc_id, text, stage).filter("not kept").select(F.col("locator").alias("_locator"))
    gone = Staging(docs.sparkSession, "dropped").table(gone, "rows")
    stage.drop()
    return anti_join(packed(docs), gone, "_locator").select("_row.*")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), k=3, percent=85).drop("locator")
