"""Phrase collocation mining: frequent phrases whose words meet more often than their own frequencies explain.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. Frequent
words of a language are encoded by a dictionary; pieces are broken at all others. Runs of n ids are packed into binary
keys of 8 n bytes, counted within each slice of texts, dealt out by ranges of their spread bits, and in each range
radix-sorted and counted by run length. Phrases of n words are looked for only where both phrases of n - 1 words inside are
frequent (n = 2: both words), so that few keys are formed.

Ids are 64-bit hashes of language and word, so no dictionary is sent to tasks: they get a bit map of 4 MiB of the frequent ids,
which lets through all of these and some others. What else it lets through is counted in vain, never wrongly. Should two
words of the dictionary share an id, all ids are made anew from another seed. Counts are therefore exact, over all texts; no
partition gets more than one row of a key from each slice, however frequent it is.

A phrase's cut after its first k words has l and r, the frequencies of both sides, and the score
floor(1,000,000 a^2 / (l r)), in decimals of 38 digits; the lowest cut counts, of equal ones the first. Phrases
inside of a longer frequent phrase that has at least ``inside`` percent of their occurrences are dropped. Each language's
``top`` phrases by score, frequency and bytes are ranked: first in 64 parts of a language, then among the parts' best.

Defined results: null text is empty; a null language is ``und``, one with documents of that name; repeated rows count
each; texts of any length are read whole, pieces never cross texts; ties of score and frequency are in order of bytes;
an empty table, or one without frequent phrases, gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Staging, documents, text_groups
from .vectors import MIX, as_array, bit_map, kinds, may_hold, mixed, parts_for, radix_order, range_of, runs_of_words, starts_of_runs

LEAST, LONGEST, TOP, INSIDE = 10, 3, 2000, 50
#: Bytes of text that a task counts at once, and keys of a partition, about.
SLICE, KEYS = 1 << 24, 1 << 22
BREAKS = b".,;:!?\n\x0b\x0c\r"
TABLE = kinds(bytes(b for b in range(256) if b not in BREAKS + b" \t"), BREAKS)
OUTSIDE = BREAKS + b" \t"
#: Parts of a language that are ranked apart before all are.
SALTS = 64


def encoded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words of all texts in order, the words of the codes, and whether a break precedes each word."""
    data = b"\n" + b"\n".join(texts.cast(pa.binary()).to_pylist()) + b"\n"
    data = data.lower()
    starts, ends, breaks = runs_of_words(data, TABLE)
    words = as_array(data.translate(None, OUTSIDE), ends - starts).dictionary_encode()
    new = np.zeros(len(starts) + 1, bool)
    new[np.searchsorted(starts, breaks)] = True
    return words.indices.to_numpy(zero_copy_only=False), words.dictionary, new[:-1]


def by_language(batches):
    """Slices of (language, texts) of one language each."""
    for batch in batches:
        for part in text_groups(batch, SLICE):
            langs = part.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, part.column(1).filter(pc.equal(langs.indices, i))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n), and with a null word the number of all words of a language."""

    def run(batches):
        for lang, column in by_language(batches):
            codes, words, _ = encoded(column)
            n = pa.array(np.append(np.bincount(codes, minlength=len(words)), len(codes)).astype(np.int64))
            names = pa.concat_arrays([words.cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), names, n], ["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_ids(words: DataFrame, seed: int) -> DataFrame:
    """Adds id, the same number that id_numbers() gives."""
    return words.withColumn("id", F.xxhash64(F.concat(F.lit(f"{seed}:"), "lang"), "word"))


def id_numbers(lang: str, words: pa.Array, seed: int) -> np.ndarray:
    start = xxhash.xxh64_intdigest(f"{seed}:{lang}".encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, start) for w in words.to_pylist()), np.uint64, len(words))


def dictionary(stage: Staging, counts: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """Words with ids of their own, and the seed that gives these."""
    while True:
        words = stage.table(with_ids(counts.filter("word is not null"), seed), f"dictionary-{seed}")
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed
        seed += 1


def mark_of(ids: np.ndarray) -> np.ndarray:
    """64 spread bits for each row of ids."""
    out = ids[:, 0].copy()
    with np.errstate(over="ignore"):
        for j in range(1, ids.shape[1]):
            out = mixed(out * MIX[0] + np.uint64(j)) ^ ids[:, j]
    return mixed(out)


def packed_codes(columns: list[np.ndarray], size: int) -> np.ndarray:
    """Tuples of codes below ``size`` as one 64-bit number each; prefixes are numbered anew where bits don't suffice."""
    bits, room = max(1, int(size - 1).bit_length()), 64
    out, used = columns[0].astype(np.uint64), bits
    for column in columns[1:]:
        if used + bits > room:
            known, out = np.unique(out, return_inverse=True)
            out, used = out.astype(np.uint64), max(1, len(known).bit_length())
        out, used = out << np.uint64(bits) | column.astype(np.uint64), used + bits
    return out


def phrase_places(codes: np.ndarray, new: np.ndarray, ids: np.ndarray, maps: list[np.ndarray], n: int) -> np.ndarray:
    """Where phrases of n words start that no break cuts and whose parts may all be frequent: maps[m - 1] knows those of m words."""
    good = may_hold(maps[0], mark_of(ids[:, None]))[codes]
    at = np.flatnonzero(good)
    for m in range(2, n + 1):
        # a phrase of m words starts where phrases of m - 1 words start here and one word on, without a break between
        nxt = np.zeros(len(codes) + 1, bool)
        nxt[at] = True
        at = at[nxt[at + 1]]
        at = at[~new[at + 1]] if m == 2 else at
        if m < n:
            at = at[may_hold(maps[m - 1], mark_of(np.stack([ids[codes[at + j]] for j in range(m)], axis=1)))]
    return at


def phrase_counts(texts: DataFrame, n: int, seed: int, maps: list[np.ndarray], parts: int, least: int) -> DataFrame:
    """(key, a, mark) of the phrases of n words that occur ``least`` times or more."""
    kind = np.dtype((">u8", n))

    def slices(batches):
        for lang, column in by_language(batches):
            codes, words, new = encoded(column)
            ids = id_numbers(lang, words, seed)
            at = phrase_places(codes, new, ids, maps, n)
            _, first, times = np.unique(packed_codes([codes[at + j] for j in range(n)], len(words)), return_index=True, return_counts=True)
            found = np.stack([ids[codes[at[first] + j]] for j in range(n)], axis=1) if len(first) else np.zeros((0, n), np.uint64)
            part = range_of(mark_of(found), parts)
            order = np.lexsort((*found.T[::-1], part))
            part, keys, times = part[order], found[order].astype(">u8"), times[order].astype("<u4")
            cuts = starts_of_runs(part[1:] == part[:-1], len(part))
            spans = list(zip(cuts, [*cuts, len(part)][1:], strict=True))
            rows = [pa.array(part[cuts], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([times[a:b].tobytes() for a, b in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["part", "keys", "times"])

    def count(batches):
        keys, times = [np.zeros((0, n), np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(np.frombuffer(k, kind).reshape(-1, n).astype(np.uint64))
                times.append(np.frombuffer(t, "<u4").astype(np.int64))
        ids, times = np.concatenate(keys), np.concatenate(times)
        mark = mark_of(ids)
        order = radix_order(mark)
        same = lambda x: (x[1:] == x[:-1]).reshape(len(x) - 1, -1).all(axis=1) if len(x) else np.zeros(0, bool)
        if (same(mark[order]) & ~same(ids[order])).any():  # other keys of one mark: put equal keys together
            order = np.lexsort((*ids.T[::-1], mark))
        ids, mark, times = ids[order], mark[order], times[order]
        cuts = starts_of_runs(same(ids), len(ids))
        a = np.add.reduceat(times, cuts) if len(cuts) else times
        kept = cuts[a >= least]
        flat = ids[kept].astype(">u8").tobytes()
        yield pa.RecordBatch.from_arrays([as_array(flat, np.full(len(kept), 8 * n)), pa.array(a[a >= least], pa.int64()), pa.array(mark[kept].view(np.int64))], ["key", "a", "mark"])

    dealt = texts.mapInArrow(slices, "part int, keys binary, times binary").repartitionById(parts, F.col("part"))
    return dealt.select("keys", "times").mapInArrow(count, "key binary, a long, mark long")


def side(key: str, start: int, words: int) -> Column:
    """Ids of so many words of a key, from one of its words on."""
    return F.substring(key, 8 * start + 1, 8 * words)


def scored(levels: list[DataFrame], counts: DataFrame, n: int) -> DataFrame:
    """(key, lang, phrase, a, l, r, score) of phrases of n words; levels[m - 1] has key, lang, phrase and a of those of m words."""
    out = counts.select("key", "a")
    for k in range(1, n):
        left = levels[k - 1].select(F.col("key").alias("_left"), F.col("a").alias(f"l{k}"), F.col("lang").alias("_lang"), F.col("phrase").alias("_head"))
        right = levels[n - k - 1].select(F.col("key").alias("_right"), F.col("a").alias(f"r{k}"), F.col("phrase").alias("_tail"))
        last = k == n - 1
        kept = out.columns
        out = out.withColumns({"_left": side("key", 0, k), "_right": side("key", k, n - k)}).join(left, "_left").join(right, "_right")
        out = out.select(*kept, f"l{k}", f"r{k}", *([F.col("_lang").alias("lang"), F.concat_ws(" ", "_head", "_tail").alias("phrase")] if last else []))
    count = lambda c: f"cast({c} as decimal(15, 0))"  # noqa: E731  products of two have 30 digits, with the factor 37
    for k in range(1, n):
        out = out.withColumn(f"s{k}", F.expr(f"{count('a')} * {count('a')} * cast(1000000 as decimal(7, 0)) div ({count(f'l{k}')} * {count(f'r{k}')})"))
    cuts = [F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, n)]
    best = F.least(*cuts) if n > 2 else cuts[0]
    return out.select("key", "lang", "phrase", "a", best.alias("b")).select("key", "lang", "phrase", "a", "b.l", "b.r", "b.score")


def not_inside(found: DataFrame, n: int, longer: list[tuple[int, DataFrame]], inside: int) -> DataFrame:
    """Phrases of n words without those that a longer frequent phrase holds in ``inside`` percent of their occurrences or more."""
    held = [x.select(side("key", start, n).alias("key"), F.col("a").alias("more")) for m, x in longer for start in range(m - n + 1)]
    if not held:
        return found
    most = reduce(DataFrame.unionByName, held).groupBy("key").agg(F.max("more").alias("more"))
    return found.join(most, "key", "left").filter(F.col("more").isNull() | (100 * F.col("more") < inside * F.col("a"))).drop("more")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases of 2 to ``longest`` words that occur ``least`` times or more."""
    stage = Staging(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = stage.table(word_counts(texts).filter(F.col("word").isNull() | (F.col("n") >= least)), "words")
    totals = counts.filter("word is null").select("lang", "n")
    words, seed = dictionary(stage, counts)
    parts = parts_for(docs, totals.agg(F.sum("n")).first()[0] or 0, KEYS)
    spread = words.select(F.col("id").alias("mark")).mapInArrow(_spread, "mark long")
    maps = [bit_map(spread, "mark")]
    levels = [words.select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), "lang", F.col("word").alias("phrase"), F.col("n").alias("a"))]
    found: list[tuple[int, DataFrame]] = []
    for n in range(2, longest + 1):
        frequent = stage.table(phrase_counts(texts, n, seed, maps, parts, least), f"phrases-{n}")
        found.append((n, stage.table(scored(levels, frequent, n), f"scored-{n}")))
        levels.append(found[-1][1].select("key", "lang", "phrase", "a"))
        if n < longest:
            maps.append(bit_map(frequent, "mark"))
    kept = [not_inside(x, n, [y for y in found if y[0] > n], inside) for n, x in found]
    rows = reduce(DataFrame.unionByName, kept).drop("key")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _spread(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(mark_of(ids[:, None]).view(np.int64))], ["mark"])


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, w FROM (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS x FROM documents))),
t AS (SELECT lang, piece, i, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM p)),
u AS (SELECT lang, w1 AS phrase, count(*) AS a FROM t GROUP BY ALL),
b AS (SELECT lang, w1, w2, count(*) AS a FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, w1, w2, w3, count(*) AS a FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
s AS (SELECT c.lang, c.w1, c.w2, c.w3, c.a, x.a AS l1, y.a AS r1, z.a AS l2, v.a AS r2, (c.a::HUGEINT * c.a * 1000000) // (x.a::HUGEINT * y.a) AS s1, (c.a::HUGEINT * c.a * 1000000) // (z.a::HUGEINT * v.a) AS s2
  FROM c JOIN u x ON x.lang = c.lang AND x.phrase = c.w1 JOIN b y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3 JOIN b z ON z.lang = c.lang AND z.w1 = c.w1 AND z.w2 = c.w2 JOIN u v ON v.lang = c.lang AND v.phrase = c.w3),
inside AS (SELECT lang, w1, w2, max(a) AS more FROM (SELECT lang, w1, w2, a FROM c UNION ALL SELECT lang, w2, w3, a FROM c) GROUP BY ALL),
every AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.a, x.a AS l, y.a AS r, (b.a::HUGEINT * b.a * 1000000) // (x.a::HUGEINT * y.a) AS score FROM b JOIN u x ON x.lang = b.lang AND x.phrase = b.w1 JOIN u y ON y.lang = b.lang AND y.phrase = b.w2
  LEFT JOIN inside i ON i.lang = b.lang AND i.w1 = b.w1 AND i.w2 = b.w2 WHERE i.more IS NULL OR 100 * i.more < {INSIDE} * b.a
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM s)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM every)
JOIN (SELECT lang, sum(a)::BIGINT AS n FROM u GROUP BY lang) USING (lang) WHERE rank <= {TOP}"""
