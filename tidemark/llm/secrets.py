"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order character models are trained from labelled strings: values that patterns or a seeded
generator give as random strings, and the other tokens of all texts, with a generator's names, dates, times, serial and
product names and numbers, as ordinary identifiers. What of a run of key characters no pattern has matched is a secret if
it has 10 characters or more and the log-likelihood ratio of the two models is high, in all and by character; no other
rule decides, so strings of letters alone are found too. For the least ratio each string is judged by a model of the other
folds' counts, folds being dealt by the CRC-32 of the string: at most three in 10,000 of the generator's ordinary strings may
exceed it, and one in 10,000 of the table's, as those hold secrets that no pattern knows. Most UUIDs are reported: models of
pairs of characters cannot tell them from keys. Long numbers are ordinary.

Every row is counted, on the executors, in whole numbers, so any partitioning gives the same models; texts don't come
to the driver. Defined results: null text is empty; empty text has no spans; an empty table gives an empty result; whole
texts are searched, of any length; repeated rows are searched and counted each; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_texts, span_text, tallied

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of hex digits is maximal, so asking for 32 finds just the runs that have them.
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Shorter strings are not judged: too few characters for a ratio to tell.
LEAST_LENGTH = 10
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
#: Least ratio of a run in nats, and by character.
LEAST_RATIO, LEAST_BY_CHARACTER = 12.0, 0.8
#: Strings of each class from the generator, and the folds that strings are dealt into.
RANDOM_STRINGS, FOLDS = 3000, 4
#: A table's counts, ordinary and random, weigh at most so many times the generator's: else what a large table lacks
#: would become ever less likely, and the least ratio and the misses grow with its size.
TABLE_WEIGHT = (20.0, 0.1)
#: Shares of a table's and of the generator's ordinary strings that may exceed the least ratio, a multiple of 1 / STEPS nats.
ALLOWED, MADE_ALLOWED, STEPS = 1e-4, 3e-4, 2
#: Strings whose scores a task keeps, as texts repeat them.
KEPT_SCORES = 1 << 16
#: Of these words the ordinary identifiers are put together that texts may lack.
VOCABULARY = (
    "get set is has this an ordinary identifier name user account settings page index value total count list path size handler config default "
    "error message request response server client data file read write open close start end first last next previous create update delete "
    "find search filter sort group by with from to for and or not in on of the session manager service factory builder parser token key table "
    "column row width height color image button event listener callback async thread process memory buffer stream input output format version"
)
_ALPHABET = string.ascii_letters + string.digits + "+/_=-."
_CODE = np.full(128, len(_ALPHABET), dtype=np.int16)
_CODE[[ord(c) for c in _ALPHABET]] = range(len(_ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass, leftmost and non-overlapping by kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def fold(s: str) -> int:
    return zlib.crc32(s.encode()) % FOLDS


def counts(samples: Iterable[tuple[str, int]]) -> np.ndarray:
    """How often each character follows each, by fold, in ordinary (0) and random (1) strings; the last state is the outside."""
    n, by = len(_ALPHABET) + 1, [[] for _ in range(2 * FOLDS)]
    for s, y in samples:
        by[2 * fold(s) + y].append(s + "\0")  # the separator is coded as the outside
    out = np.zeros((2 * FOLDS, n * n), dtype=np.int64)
    for i, strings in enumerate(by):
        c = _codes("".join(strings))
        out[i] = np.bincount(c[:-1] * n + c[1:], minlength=n * n)
    return out.reshape(FOLDS, 2, n, n)


def weighed(made: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The generator's counts and a table's, the latter by class at most TABLE_WEIGHT times the former."""
    share = np.minimum(1.0, np.array(TABLE_WEIGHT) * made.sum(axis=(1, 2)) / np.maximum(1, found.sum(axis=(1, 2))))
    return made + found * share[:, None, None]


class Markov:
    """Log probabilities of a character after another, with add-one smoothing."""

    def __init__(self, found: np.ndarray):
        self.log = np.log((found + 1.0) / (found + 1.0).sum(axis=1, keepdims=True))

    def score(self, s: str) -> float:
        c = _codes(s)
        return float(self.log[c[:-1], c[1:]].sum())


def _codes(s: str) -> np.ndarray:
    return np.concatenate([[len(_ALPHABET)], _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)].astype(np.int64)])


@dataclass
class Detector:
    random_strings: Markov
    identifiers: Markov
    least: float = LEAST_RATIO

    def ratio(self, s: str) -> float:
        return self.random_strings.score(s) - self.identifiers.score(s)

    def is_random(self, s: str) -> bool:
        if len(s) < LEAST_LENGTH:
            return False
        r = self.ratio(s)
        return r > self.least and r >= LEAST_BY_CHARACTER * len(s)

    def spans(self, text: str, base: list[tuple[int, int, int]], judge: Callable[[str], bool] | None = None) -> list[tuple[int, int, int]]:
        """Random strings: runs, or what base spans leave of them. Both are in order, so one pass compares them."""
        found, taken, at, end = [], sorted(base), 0, 0
        judge = judge or self.is_random
        for m in RUN.finditer(text):
            start = max(m.start(), end)
            parts = []
            while at < len(taken) and taken[at][0] < m.end():
                parts.append((start, taken[at][0]))
                end = max(end, taken[at][2])
                start = max(start, end)
                at += 1
            parts.append((start, m.end()))
            found += [(a, 3, b) for a, b in parts if b - a >= LEAST_LENGTH and judge(text[a:b])]
        return found


def _named(rng: random.Random) -> str:
    """Common words in one of the usual styles, some with a number behind."""
    parts = rng.choices(VOCABULARY.split(), k=rng.randint(2, 5))
    style = rng.choice(("_", "-", "/", "camel", "upper"))
    if style == "camel":
        name = parts[0] + "".join(p.title() for p in parts[1:])
    else:
        name = "_".join(parts).upper() if style == "upper" else style.join(parts)
    return name + rng.choice(("", "", "2", "10"))


def _dated(rng: random.Random) -> str:
    """A date or time as written in logs, files and addresses, alone or beside words and letters."""
    y, m, d, h, n, s = rng.randint(1950, 2039), rng.randint(1, 12), rng.randint(1, 28), rng.randrange(24), rng.randrange(60), rng.randrange(60)
    day = rng.choice((f"{y}-{m:02}-{d:02}", f"{y}{m:02}{d:02}", f"{y}/{m:02}/{d:02}", f"{y}_{m:02}_{d:02}"))
    time = rng.choice(("", "", f"T{h:02}", f"T{h:02}{n:02}{s:02}Z", f"-{h:02}{n:02}", f"_{h:02}{n:02}{s:02}"))
    before = rng.choice(("", "", _code(rng) + rng.choice("-_"), rng.choice(VOCABULARY.split()) + rng.choice("-_/")))
    return before + day + time + rng.choice(("", "", "", "-" + _code(rng), "_" + rng.choice(VOCABULARY.split())))


def _code(rng: random.Random) -> str:
    """Letters of one case and a number, as in models, flights, standards and versions."""
    letters = "".join(rng.choices(string.ascii_uppercase, k=rng.randint(1, 2)))
    number = str(rng.randrange(10 ** rng.randint(1, 5)))
    return rng.choice((letters + number, letters + "-" + number, letters, number, f"v{number}", rng.choice(VOCABULARY.split()) + number, rng.choice(VOCABULARY.split()).title() + "-" + number))


def _numbered(rng: random.Random) -> str:
    """Serial and product names: codes and words in a row; or a long number."""
    if rng.random() < 0.15:
        return str(rng.randrange(10 ** rng.randint(LEAST_LENGTH - 1, 16)))
    word = lambda: rng.choice((str.lower, str.title, str.upper))(rng.choice(VOCABULARY.split()))
    return rng.choice("-_/").join(rng.choice((_code, _code, lambda _: word()))(rng) for _ in range(rng.randint(2, 4)))


def made_samples(seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1 if random) from a seeded generator: random strings of several alphabets, some without digits; names of
    common words, dates and times, serial and product names, long numbers."""
    rng = random.Random(seed)
    letters = string.ascii_letters
    alphabets = ("0123456789abcdef", letters + string.digits, letters + string.digits + "+/", string.ascii_uppercase + string.digits, letters, string.ascii_lowercase, string.ascii_uppercase)
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(LEAST_LENGTH, 64))), 1) for _ in range(RANDOM_STRINGS)]
    for make in (_named, _dated, _numbered):
        out += [(make(rng), 0) for _ in range(RANDOM_STRINGS)]
    return out


def text_samples(texts: Iterable[str]) -> Iterator[tuple[str, int]]:
    """(string, 1 if random): the patterns' values against the texts' other tokens."""
    for t in texts:
        base = sorted(base_spans(t))
        for a, k, b in base:
            yield (ASSIGN.sub(r"\2", t[a:b]) if k == 0 else t[a:b]), 1
        at = 0
        for a, _, b in [*base, (len(t), 0, len(t))]:
            yield from ((x, 0) for x in TOKEN.findall(t, at, max(at, a)))
            at = max(at, b)


def labelled_samples(texts: list[str]) -> list[tuple[str, int]]:
    return list(text_samples(texts))


def detector_of(found: np.ndarray) -> Detector:
    return Detector(Markov(found[1]), Markov(found[0]))


def by_fold(made: np.ndarray, found: np.ndarray) -> list[Detector]:
    """For the strings of each fold, a model of the others."""
    return [detector_of(weighed(made.sum(axis=0) - made[i], found.sum(axis=0) - found[i])) for i in range(FOLDS)]


def heights(samples: Iterable[tuple[str, int]], models: list[Detector]) -> Counter[int]:
    """How many ordinary strings there are by ratio, rounded up to steps; 0: what is never taken for random."""
    out, n = Counter(), 0
    ratio = lru_cache(KEPT_SCORES)(lambda s: models[fold(s)].ratio(s))
    for s, y in samples:
        if y:
            continue
        n += 1
        if len(s) >= LEAST_LENGTH:
            r = ratio(s)
            if r > 0 and r >= LEAST_BY_CHARACTER * len(s):
                out[math.ceil(r * STEPS)] += 1
    out[0] += n - out.total()
    return out


def least_ratio(found: Counter[int], allowed: float) -> float:
    """The least step, LEAST_RATIO or above, that no more than the allowed share of strings exceed."""
    above, most = 0, allowed * found.total()
    for height in sorted(found, reverse=True):
        above += found[height]
        if above > most:
            return max(LEAST_RATIO, height / STEPS)
    return LEAST_RATIO


def train(samples: list[tuple[str, int]]) -> Detector:
    """A detector from the generator's strings and these."""
    return learn(lambda: counts(samples), lambda models: heights(samples, models))


def learn(count, measure) -> Detector:
    """``count()`` has the table's counts, ``measure(models)`` the heights of its ordinary strings."""
    generated = made_samples()
    made, found = counts(generated), count()
    models = by_fold(made, found)
    model = detector_of(weighed(made.sum(axis=0), found.sum(axis=0)))
    model.least = max(least_ratio(heights(generated, models), MADE_ALLOWED), least_ratio(measure(models), ALLOWED))
    return model


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Detector:
    """The same from all rows of a table: counts, then heights, are summed on the executors."""
    shape = (FOLDS, 2, len(_ALPHABET) + 1, len(_ALPHABET) + 1)

    def count_part(parts):
        total = np.zeros(shape, dtype=np.int64)
        for _, texts in parts:
            total += counts(text_samples(t or "" for t in texts))
        cells = np.flatnonzero(total)
        return cells, total.ravel()[cells]

    def count() -> np.ndarray:
        found = np.zeros(math.prod(shape), dtype=np.int64)
        cells, n = tallied(docs, doc_id, text, count_part)
        found[cells] = n
        return found.reshape(shape)

    def measure(models: list[Detector]) -> Counter[int]:
        def measure_part(parts):
            total = heights((x for _, texts in parts for x in text_samples(t or "" for t in texts)), models)
            return list(total), list(total.values())

        return Counter(dict(zip(*(x.tolist() for x in tallied(docs, doc_id, text, measure_part)), strict=True)))

    return learn(count, measure)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", detector: Detector | None = None) -> DataFrame:
    """One row a document: counts by kind, base_sha256, and spans of all kinds."""
    model = detector or fit(docs, doc_id, text)

    def rows(texts: list[str]):
        judge = lru_cache(KEPT_SCORES)(model.is_random)
        for t in texts:
            base = base_spans(t)
            more = model.spans(t, base, judge)
            n = [0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            yield *n, hashlib.sha256(span_text(base, KINDS).encode()).hexdigest(), span_text(base + more, KINDS), len(more)

    long, text_type = pa.int64(), pa.string()
    return map_texts(docs, doc_id, text, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long", rows, [long, long, long, text_type, text_type, long])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
