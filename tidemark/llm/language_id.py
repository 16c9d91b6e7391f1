"""Language identification by error-correcting output codes over byte trigrams.

Each language has a codeword of +1 and -1: all splits of the languages in two for up to six of them, else as many pseudo-random
splits as keep codewords far apart. For each bit a binary classifier, naive Bayes on hashed trigrams of lower-cased (A-Z)
letters and spaces, tells languages of +1 from those of -1; languages weigh alike on either side, however many documents
each has. A text's codeword has real numbers, log-odds; the language whose codeword has the least logistic loss is
predicted, each bit weighing by how often its classifier was right on documents of that language (loss-weighted decoding).
``score`` is that language's share of exp(-loss), and a text is flagged ambiguous where the next language comes within MARGIN of it.

All rows of the training part with a language and a letter are counted, twice: trigrams by language, then right bits. The driver
gets sums alone, at most CELLS numbers. Weights are whole multiples of 1 / ONE nat, so any partitioning gives the
same sums. Text alone is an input of a prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything if no language is
known; with one language that is predicted with score 1; ties go to the first language by name; a null doc_id is neither
held out nor learnt from; repeated rows count each; whole texts of any length are read; more than MOST languages raise an error;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts, tallied

FOLDS, HELD_OUT = 3, 1
#: Hash buckets of trigrams with up to 64 languages, fewer with more; the most languages.
BUCKETS, CELLS, MOST = 1 << 16, 1 << 22, 1 << 10
ONE = 1 << 16
MARGIN = 0.5
#: Bytes of letters stay, all others are spaces.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Splits are all tried for so many languages; else this many for each doubling of their number, the best of some draws.
EXHAUSTIVE, SPLITS, DRAWS = 6, 12, 16


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages; no column is constant."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        return np.array([(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest], np.int8).T
    width, best = SPLITS * int(n - 1).bit_length(), None
    for draw in range(DRAWS):
        bits = np.array([[hashlib.md5(f"{draw}:{j}:{i}".encode()).digest()[0] & 1 for j in range(width)] for i in range(n)], np.int8) * 2 - 1
        bits[0] = np.where(np.abs(bits.sum(axis=0)) == n, -bits[0], bits[0])
        apart = ((width - (bits.astype(int) @ bits.T)) // 2 + width * np.eye(n, dtype=int)).min()
        if best is None or apart > best[0]:
            best = apart, bits
    return best[1]


def buckets_for(languages: int) -> int:
    return BUCKETS >> max(0, (max(1, languages) - 1).bit_length() - (CELLS // BUCKETS - 1).bit_length())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of all texts, each between two spaces, and where each text's begin; two between texts have the bucket ``buckets``."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" " + b"  ".join(raw).lower().translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    h = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761) >> np.uint32(33 - buckets.bit_length())
    ends = np.cumsum([len(r) + 2 for r in raw])
    between = ends[:-1]
    h[between - 2] = h[between - 1] = buckets
    return h, np.concatenate([[0], between]).astype(np.int64)


@dataclass
class Codes:
    """Languages, their codewords, integer weights by bit and bucket, and how much each bit counts for each language."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def odds(self, texts: list[str]) -> np.ndarray:
        """Log-odds of each bit for texts with letters, over the root of the text's trigrams, as these depend on
        each other; sums of whole numbers, the same in any batch."""
        h, starts = trigrams(texts, self.weights.shape[1] - 1)
        size = np.diff([*starts, len(h) + 2]) - 2
        out = [np.add.reduceat(w[h], starts) for w in self.weights]
        return np.stack(out, axis=1) / ONE / np.sqrt(size)[:, None] if out else np.zeros((len(texts), 0))

    def decide(self, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, scores, and leads over the next language."""
        loss = np.stack([(self.trust[i] * np.logaddexp(0, -word * odds)).sum(axis=1) for i, word in enumerate(self.words)], axis=1)
        best = loss.argmin(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        ordered = np.sort(share, axis=1)
        return best, ordered[:, -1], ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)


def weights_of(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log-odds of a bucket between the languages of +1 and those of -1, of each bit; the bucket between texts has none."""
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
    out = np.zeros((words.shape[1], counts.shape[1] + 1), np.int64)
    for b, bit in enumerate(words.T):
        out[b, :-1] = np.rint(ONE * np.log(share[bit > 0].mean(axis=0) / share[bit < 0].mean(axis=0)))
    return out


def by_language(languages: int, buckets: int):
    """Trigrams by language and bucket."""

    def count(parts):
        total = np.zeros((languages, buckets + 1), np.int64)
        for langs, texts in parts:
            for i in set(langs):
                own = [t for k, t in zip(langs, texts, strict=True) if k == i and has_letter(t)]
                if own:
                    total[i] += np.bincount(trigrams(own, buckets)[0], minlength=buckets + 1)
        flat = total[:, :-1].ravel()
        cells = np.flatnonzero(flat)
        return cells, flat[cells]

    return count


def right_bits(codes: Codes):
    """By language: the texts, and those whose sign is right, of each bit."""
    n, width = codes.words.shape

    def count(parts):
        total = np.zeros((n, width + 1), np.int64)
        for langs, texts in parts:
            rows = [(k, t) for k, t in zip(langs, texts, strict=True) if has_letter(t)]
            if rows:
                k = np.array([r[0] for r in rows])
                right = codes.odds([r[1] for r in rows]) * codes.words[k] > 0
                np.add.at(total, k, np.concatenate([np.ones((len(k), 1), np.int64), right], axis=1))
        return np.arange(total.size), total.ravel()

    return count


def learn(train: DataFrame) -> Codes:
    """From a table (lang, text)."""
    languages = [r.lang for r in train.select("lang").distinct().orderBy("lang").limit(MOST + 1).collect()]
    if len(languages) > MOST:
        raise ValueError(f"more than {MOST} languages")
    n, buckets, words = len(languages), buckets_for(len(languages)), codewords(len(languages))
    if n < 2:
        return Codes(languages, words, np.zeros((0, buckets + 1), np.int64), np.zeros((n, 0)))
    numbered = train.select((F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1).cast("int").alias("k"), "text")

    def sums(count, shape: tuple[int, int]) -> np.ndarray:
        cells, found = tallied(numbered, "k", "text", count)
        out = np.zeros(shape[0] * shape[1], np.int64)
        out[cells] = found
        return out.reshape(shape)

    codes = Codes(languages, words, weights_of(sums(by_language(n, buckets), (n, buckets)), words), np.ones(words.shape))
    right = sums(right_bits(codes), (n, words.shape[1] + 1))
    trust = right[:, 1:] / np.maximum(1, right[:, :1])
    trust[trust.sum(axis=1) == 0] = 1
    codes.trust = trust * words.shape[1] / trust.sum(axis=1, keepdims=True)
    return codes


def predict(docs: DataFrame, codes: Codes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""

    def rows(texts: list[str]) -> Iterator[tuple[str, float, bool]]:
        known = [i for i, t in enumerate(texts) if codes.languages and has_letter(t)]
        out = [("und", 0.0, True)] * len(texts)
        if known:
            found = codes.decide(codes.odds([texts[i] for i in known]))
            for i, best, score, lead in zip(known, *(x.tolist() for x in found), strict=True):
                out[i] = codes.languages[best], score, lead < MARGIN
        return iter(out)

    return map_texts(docs, doc_id, text, "lang_pred string, score double, ambiguous boolean", rows, [pa.string(), pa.float64(), pa.bool_()])


def training(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    known = F.col(doc_id).isNotNull() & ~is_held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()
    return docs.filter(known).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, learnt from the rows that are not held out."""
    found = predict(docs, learn(training(docs, doc_id, text, lang)), doc_id, text)
    return found.select(doc_id, is_held_out(F.col(doc_id)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
