"""Quality classifier: Bradley-Terry ranking from preference pairs, then a threshold by score quantile.

Every pair of a good and a bad document of the training part is a preference. Strengths linear in the
documents' features are fitted by logistic loss over all these pairs, with a small ridge, by Newton's method.
Pairs are not made: the loss needs the strengths alone, so executors sum the documents by class and bin of
strength (BINS a nat), and the driver compares bins, at the mean strength of each. The strength at the
quantile that is the bad documents' share becomes the score THRESHOLD, known to 1 / STEPS nats; the score is a
logistic curve through it.

All rows of the training part are read for labels, no others. Sums are of whole numbers, so any partitioning
gives the same model. Features come from the whole text alone; labels, lang, source and doc_id are
no inputs. Defined results: null text is empty and scored as such; without both labels the model is
flat and scores THRESHOLD; repeated rows are scored and learnt from each, repeated rows of labels count once; rows of
labels without a document do not count; a null doc_id is not held out; an empty table gives an empty result; whole
texts of any length are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staging, documents, map_texts, may_match, not_broadcast, tallied

THRESHOLD = 0.7
#: Bins of strength a nat, all within REACH nats of the mean (the outer ones hold what is beyond), and steps a nat for the threshold.
BINS, REACH, STEPS = 16, 32, 1024
#: Passes over the training part at most, and the gain in loss under which they end.
PASSES, LEAST_GAIN = 40, 1e-8
#: Sums are of whole multiples of 1 / ONE; of 1 / ROUGH in second derivatives, which only steer the search.
ONE, ROUGH = 1 << 24, 1 << 10
#: Training rows of a task, about: small tasks would give more cells than they read rows.
TASK_ROWS = 20_000
SYMBOLS = "#*$%&|<>!?=~^_@{}[]"
FOLDS, HELD_OUT = 4, 2


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features(text: str) -> list[float]:
    words = text.split()
    n, k = len(words), max(1, len(words))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    share = np.bincount(raw, minlength=128)[:128] / max(1, len(raw)) if len(raw) else np.zeros(128)
    symbols = float(share[[ord(c) for c in SYMBOLS]].sum())
    upper, digit = float(share[65:91].sum()), float(share[48:58].sum())
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n),
        min(symbols * 10, 3.0),
        min(upper * 4, 3.0),
        min(digit * 10, 3.0),
        math.log(distinct + 1) / math.log(k + 1),
        again / k,
        pairs / k,
        len(set(lines)) / max(1, len(lines)),
        min(len(text) / k, 20.0) / 5,
        min(text.count(",") / k, 1.0),
        min(text.count(".") / k, 1.0),
        min(max(map(len, words), default=0), 60) / 20,
        min(text.count(" | ") * 4 / k, 3.0),
        float(n < 5),
    ]


@dataclass
class Ranking:
    """Strength of a document: weights on standardised features; ``at`` is the strength that scores THRESHOLD."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: float
    width: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self.standard(x) * self.weights).sum(axis=1)  # by row, so the same in any batch

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate([z, z * z], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.at) / self.width + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _arrays(parts, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and features of slices."""
    return ((np.asarray(y, dtype=np.int64), np.asarray(x, dtype=float).reshape(-1, width)) for y, x in parts)


def _whole(x: np.ndarray, one: int = ONE) -> np.ndarray:
    return np.rint(x * one).astype(np.int64)


def moments(width: int) -> Callable:
    """By class: the rows, the sums of features and of their squares."""

    def count(parts):
        total = np.zeros((2, 1 + 2 * width), dtype=np.int64)
        for y, x in _arrays(parts, width):
            np.add.at(total, y, np.concatenate([np.ones((len(y), 1), dtype=np.int64), _whole(x), _whole(x * x)], axis=1))
        return np.arange(total.size), total.ravel()

    return count


@dataclass
class Binned:
    """Sums by class and bin: ``rows`` and ``sums`` of standardised features; ``squares`` by class and nat, upper triangles."""

    rows: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @staticmethod
    def shapes(k: int) -> list[tuple[int, ...]]:
        return [(2, 2 * REACH * BINS), (2, 2 * REACH * BINS, k), (2, 2 * REACH, k * (k + 1) // 2)]

    @staticmethod
    def of(cells: np.ndarray, n: np.ndarray, k: int) -> Binned:
        shapes = Binned.shapes(k)
        flat = np.zeros(sum(map(math.prod, shapes)))
        flat[cells] = n
        rows, sums, squares = (x.reshape(s) for x, s in zip(np.split(flat, np.cumsum([math.prod(s) for s in shapes])[:-1]), shapes, strict=True))
        return Binned(rows, sums / ONE, squares / ROUGH**2)


def by_bin(model: Ranking, middle: float) -> Callable:
    """What Binned holds, of strengths less ``middle``."""
    width, k = len(model.mean), len(model.weights)
    upper = np.triu_indices(k)

    def count(parts):
        rows, sums, squares = (np.zeros(s, dtype=np.int64) for s in Binned.shapes(k))
        for y, x in _arrays(parts, width):
            z = model.standard(x)
            at = np.clip(np.floor((model.strength(x) - middle) * BINS), -REACH * BINS, REACH * BINS - 1).astype(np.int64) + REACH * BINS
            np.add.at(rows, (y, at), 1)
            np.add.at(sums, (y, at), _whole(z))
            group = y * 2 * REACH + at // BINS
            for g in np.unique(group):
                q = np.rint(z[group == g] * ROUGH)  # whole numbers, whose products floats add exactly
                squares[g // (2 * REACH), g % (2 * REACH)] += (q.T @ q)[upper].astype(np.int64)
        flat = np.concatenate([rows.ravel(), sums.ravel(), squares.ravel()])
        cells = np.flatnonzero(flat)
        return cells, flat[cells]

    return count


def loss_and_step(found: Binned, weights: np.ndarray, ridge: float) -> tuple[float, np.ndarray, float]:
    """Mean loss of all pairs, Newton's step from here, and the gain it promises."""
    k = len(weights)
    (bad, good), pairs = found.rows, found.rows[0].sum() * found.rows[1].sum()
    i, j = np.flatnonzero(good), np.flatnonzero(bad)
    n_i, n_j, m_i, m_j = good[i], bad[j], found.sums[1][i], found.sums[0][j]
    d = np.subtract.outer(m_i @ weights / n_i, m_j @ weights / n_j)
    wrong = np.exp(-np.logaddexp(0, d))
    weight = np.outer(n_i, n_j) / pairs
    loss = float((weight * np.logaddexp(0, -d)).sum() + ridge / 2 * weights @ weights)
    w = wrong * weight
    gradient = ridge * weights - (w.sum(axis=1) / n_i) @ m_i + (w.sum(axis=0) / n_j) @ m_j
    # Second derivatives by nat: of each pair of nats the mean curvature, times the sum of all squared differences.
    nats = np.eye(2 * REACH)
    curve = nats[i // BINS].T @ (w * (1 - wrong)) @ nats[j // BINS]
    (n_d, n_c), (m_d, m_c) = found.rows.reshape(2, -1, BINS).sum(axis=2), found.sums.reshape(2, -1, BINS, k).sum(axis=2)
    curve /= np.maximum(1, np.outer(n_c, n_d))
    packed = (curve @ n_d) @ found.squares[1] + (n_c @ curve) @ found.squares[0]
    second = np.zeros((k, k))
    second[np.triu_indices(k)] = packed
    second += np.triu(second, 1).T
    cross = m_c.T @ curve @ m_d
    second += ridge * np.eye(k) - cross - cross.T
    step = -np.linalg.solve(second, gradient)
    return loss, step, float(-gradient @ step / 2)


def strengths(model: Ranking) -> Callable:
    """Rows by class and strength, in steps; the last bit of a cell is the class."""

    def count(parts):
        cells = [2 * np.floor(model.strength(x) * STEPS).astype(np.int64) + y for y, x in _arrays(parts, len(model.mean))]
        return np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *cells]), return_counts=True)

    return count


def _at(values: np.ndarray, n: np.ndarray, places: list[int]) -> float:
    """Mean of the values at these places of the order, each value being there ``n`` times."""
    return float(values[np.searchsorted(np.cumsum(n), places, side="right")].mean())


def learn(width: int, over: Callable, ridge: float = 1e-3) -> Ranking:
    """Bradley-Terry by Newton's method: P(good before bad) is the logistic of the strengths' difference.

    ``over(count)`` has the sums by cell of what ``count`` finds in all parts of the training rows.
    """
    cells, n = over(moments(width))
    total = np.zeros((2, 1 + 2 * width))
    total.ravel()[cells] = n
    rows = total[:, 0].sum()
    mean, square = np.split(total[:, 1:].sum(axis=0) / ONE / max(1, rows), 2)
    model = Ranking(mean, np.sqrt(np.maximum(0, square - mean * mean)) + 1e-6 if rows else np.ones(width), np.zeros(2 * width), 0.0, 1.0)
    n_bad, n_good = total[:, 0].astype(int).tolist()
    if not n_good or not n_bad:
        return model
    best, gain_before, step, share, middle = math.inf, 0.0, np.zeros(2 * width), 1.0, np.zeros(2 * width)
    for _ in range(PASSES):
        weights = model.weights + share * step
        tried = Ranking(model.mean, model.scale, weights, 0.0, 1.0)
        found = Binned.of(*over(by_bin(tried, float(middle @ weights))), 2 * width)
        loss, next_step, gain = loss_and_step(found, weights, ridge)
        if loss > best:
            share /= 2
            if gain_before * share < LEAST_GAIN:
                break
            continue
        best, gain_before, model, step, share, middle = loss, gain, tried, next_step, 1.0, found.sums.sum(axis=(0, 1)) / rows
        if gain < LEAST_GAIN:
            break
    cells, n = over(strengths(model))
    order = np.argsort(cells)
    cells, n = cells[order], n[order]
    values, good = (cells // 2 + 0.5) / STEPS, cells % 2 == 1
    at = min(n_bad - 1, n_bad + n_good - 2)
    model.at = _at(values, n, [at, at + 1])
    median = lambda part, size: _at(values[part], n[part], [(size - 1) // 2, size // 2])
    model.width = max(1e-6, (median(good, n_good) - median(~good, n_bad)) / 8)
    return model


def fit(good: np.ndarray, bad: np.ndarray) -> Ranking:
    """A model from the features of good and bad documents."""
    width = max(good.shape[1], bad.shape[1])
    y, x = np.repeat([1, 0], [len(good), len(bad)]), np.concatenate([good.reshape(-1, width), bad.reshape(-1, width)])
    return learn(width, lambda count: count([(y, x)]))


def fit_table(rows: DataFrame) -> Ranking:
    """The same from a table of training rows, which is read in each pass."""
    rows = rows.coalesce(max(1, rows.count() // TASK_ROWS))
    return learn(len(features("")), lambda count: tallied(rows, "_label", "x", count))


def training_features(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """_label and features x of every document of the training part that has a label. Texts are not shuffled."""
    known = labels.select(F.col(doc_id).cast(dict(docs.dtypes)[doc_id]).alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.filter("_id is not null and _label in (0, 1)").filter(~is_held_out(F.col("_id"))).distinct()
    texts = may_match(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), known, "_id")
    return measured(texts, "_id", "_text").join(not_broadcast(known), "_id").select("_label", "x")


def measured(df: DataFrame, key: str, text: str) -> DataFrame:
    return map_texts(df, key, text, "x array<double>", lambda texts: ((features(t),) for t in texts), [pa.list_(pa.float64())])


def score(docs: DataFrame, model: Ranking, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def rows(texts: list[str]) -> Iterator[tuple[float]]:
        return ((float(s),) for s in model.score(np.array([features(t) for t in texts]))) if texts else iter(())

    return map_texts(docs, doc_id, text, "score double", rows, [pa.float64()])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    stage = Staging(spark, "quality")
    model = fit_table(stage.table(training_features(docs, labels), "training"))
    stage.drop()
    scored = score(docs, model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
