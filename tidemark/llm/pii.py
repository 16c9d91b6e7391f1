"""PII: fixed patterns, and a skip-chain conditional random field over the candidates that they leave.

The field's nodes are the text's candidates: pattern matches (whose label is known) and other runs of
digits or tokens with an @. Neighbours in the text share a chain potential. Candidates that repeat each other
(equal digits, or one address in any case) or are similar (the same last seven digits, the same local part) are tied
by skip edges, however far apart: each to a node that stands for their common key, so evidence travels two
edges whatever the number of mentions. Loopy sum-product runs until messages settle; a candidate that ends up as
personal data with high probability adds a span.

Weights are trained piecewise over all rows, from counts that are summed on the executors: of pattern matches,
of variants made of them (without + or country code, digits alone, in other case or domain), which carry their label, and of
the other candidates. An address of a machine has one form, so only its pattern labels it: what has its shape and fails is no candidate for
any label. Nodes are a weighted softmax regression; a skip potential is how often tied candidates agree.

Defined results: null text is empty; empty text has no spans; an empty table gives an empty result; whole
texts are searched, of any length; repeated rows are searched each; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts, span_text, text_groups

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
#: What only its pattern finds.
ADDRESSED = KINDS.index("ip")
#: Local part and domain are matched apart, from the @ outwards, so that long runs without one cost nothing.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does, so the look-behind changes nothing but the cost.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
#: It begins where a run does, so that a long run without @ is looked at once.
ADDRESS = re.compile(r"(?<![^\s@])[^\s@]+@[^\s@]+")
SHAPE = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
#: Messages are settled when none changes by more; rounds grow with the graph.
TOLERANCE, ROUNDS, LEAST_PROBABILITY = 1e-4, 100, 0.9
#: What ties candidates: equal digits or addresses, the last digits, the local part.
TIES = ("same", "digits", "local")
LAST_DIGITS, LEAST_LOCAL = 7, 4
#: A variant's shape alone is personal data with this chance, and no more; counts of agreement before any was made, and
#: the share of all counts that is added on either side, so that a tie says as much in a large table as in a small one.
VARIANT_WEIGHT, PRIOR, SMOOTH = 0.5, 1.0, 1e-3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int, int]]:
    spans, end = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            spans.append((start, 0, m.end()))
            end = m.end()
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass, leftmost and non-overlapping by kind."""
    spans = emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return spans
    if text.count(".") >= 3:
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return spans


@dataclass
class Candidates:
    spans: list[tuple[int, int]]
    labels: list[int]  # of pattern matches; OTHER for the rest
    known: list[bool]
    keys: list[list[tuple[int, str]]]  # (number of the tie, key)


def fails(s: str) -> bool:
    """Whether this has the shape of a machine's address, of parts of three digits at most, and is none."""
    return bool(SHAPE.fullmatch(s)) and max(map(len, s.split("."))) <= 3 and not is_address(s)


def is_address(s: str) -> bool:
    return bool(SHAPE.fullmatch(s)) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def keys_of(s: str) -> list[tuple[int, str]]:
    if "@" in s:
        local = s.lower().partition("@")[0]
        return [(0, s.lower())] + [(2, local)] * (len(local) >= LEAST_LOCAL)
    digits = "".join([c for c in s if "0" <= c <= "9"])
    if is_address(s):
        return [(0, s)]
    return [(0, digits)] + [(1, digits[-LAST_DIGITS:])] * (len(digits) >= LAST_DIGITS)


def variants(s: str, label: int) -> list[str]:
    """Ways to write a match that its pattern does not find; empty for addresses of machines, which have one."""
    digits = "".join([c for c in s if "0" <= c <= "9"])
    if label == 0:
        local, _, domain = s.partition("@")
        return [f"{local}@{domain.split('.')[0]}", f"{local.upper()}@{domain.split('.')[0]}"]
    if label == 3:
        return [digits, digits[-10:], f"{digits[-10:-7]} {digits[-7:-4]} {digits[-4:]}"]
    return [digits[:-1]] if label == 2 else []


def candidates(text: str, base: list[tuple[int, int, int]]) -> Candidates:
    """Pattern matches and the other candidates that touch none of them, in order."""
    found = [(a, b, k) for a, k, b in base]
    if DIGIT.search(text) or "@" in text:
        at, end, taken = 0, 0, sorted(base)
        for m in sorted([*NUMBER.finditer(text), *(ADDRESS.finditer(text) if "@" in text else ())], key=lambda m: m.start()):
            while at < len(taken) and taken[at][0] < m.end():
                end = max(end, taken[at][2])
                at += 1
            if end <= m.start():
                found.append((m.start(), m.end(), OTHER))
                end = m.end()
    found.sort()
    pattern = {(a, b, k) for a, k, b in base}
    return Candidates([(a, b) for a, b, _ in found], [k for _, _, k in found], [x in pattern for x in found], [keys_of(text[a:b]) for a, b, _ in found])


def features(s: str) -> list[float]:
    digits = sum([("0" <= c <= "9") for c in s])
    plain = "".join([c for c in s if "0" <= c <= "9"])
    return [1.0, "@" in s, "@" in s and "." in s.rpartition("@")[2], s.count(".") == 3, s.startswith("+"), "(" in s, " " in s or "-" in s, digits < 10, 10 <= digits <= 12, digits == 13, 14 <= digits <= 15, 16 <= digits <= 19, digits > 19, 14 <= digits <= 19 and luhn(plain)]


def ties(keys: list[list[tuple[int, str]]]) -> list[tuple[int, list[int]]]:
    """(number of the tie, members) of each key that two candidates or more have; none twice with the same members."""
    by: dict[tuple[int, str], list[int]] = {}
    for i, own in enumerate(keys):
        for key in own:
            by.setdefault(key, []).append(i)
    out: dict[tuple[int, ...], int] = {}
    for (kind, _), members in sorted(by.items()):
        if len(members) > 1:
            out.setdefault(tuple(members), kind)
    return [(kind, list(members)) for members, kind in out.items()]


@dataclass
class SkipChain:
    """Log potentials: nodes by feature and label, chain edges by pairs of labels, skip edges by tie and pairs of labels."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, texts: list[str], c: Candidates) -> np.ndarray:
        """Loopy sum-product over all candidates of a text and their keys; all messages of a round are sent at once."""
        n, size, tied = len(texts), OTHER + 1, ties(c.keys)
        unary = np.zeros((n + len(tied), size))
        unary[:n] = np.array([features(s) for s in texts]) @ self.node
        known = np.flatnonzero(c.known)
        unary[known] = -50.0
        unary[known, np.array(c.labels)[known]] = 0.0
        skips = [(i, n + hub) for hub, (_, members) in enumerate(tied) for i in members]
        kinds = [kind for kind, members in tied for _ in members]
        edges = np.array([(i, i + 1) for i in range(n - 1)] + skips, dtype=int).reshape(-1, 2)
        potential = np.concatenate([np.broadcast_to(self.chain, (n - 1, size, size)), self.skip[np.array(kinds, dtype=int)]])
        e = len(edges)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        both = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        message = np.zeros((2 * e, size))
        belief = unary
        for _ in range(ROUNDS + 2 * n if e else 0):
            out = (belief[source] - message[back])[:, :, None] + both
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
            change, message = np.abs(new - message).max(), new
            belief = unary.copy()
            np.add.at(belief, target, message)
            if change < TOLERANCE:
                break
        p = np.exp(belief[:n] - belief[:n].max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """What the field adds: candidates outside of the patterns' matches with a personal label."""
        c = candidates(text, base)
        if all(c.known):
            return []
        p = self.marginals([text[a:b] for a, b in c.spans], c)
        best = p.argmax(axis=1)
        return [(a, int(k), b) for (a, b), known, k, x in zip(c.spans, c.known, best, p, strict=True) if not known and k != OTHER and k != ADDRESSED and x[k] >= LEAST_PROBABILITY and not fails(text[a:b])]


def tally(texts: list[str]) -> Counter:
    """Weighted counts: ("node", features, label), ("chain", label, label), ("tie", number, 1 if the two agree)."""
    out: Counter = Counter()
    for t in texts:
        c = candidates(t, base_spans(t))
        for (a, b), label, known in zip(c.spans, c.labels, c.known, strict=True):
            s = t[a:b]
            out["node", tuple(map(float, features(s))), label] += 1
            for v in variants(s, label) if known else ():
                out["node", tuple(map(float, features(v))), label] += VARIANT_WEIGHT
                out["node", tuple(map(float, features(v))), OTHER] += 1 - VARIANT_WEIGHT
                out.update(("tie", kind, 1) for kind, _ in set(keys_of(s)) & set(keys_of(v)))
        out.update(("chain", a, b) for a, b in zip(c.labels, c.labels[1:], strict=False))
        for kind, members in ties(c.keys):
            for i, j in zip(members, members[1:], strict=False):
                # a match and a candidate that no pattern finds say nothing of each other: it may be a variant
                if c.known[i] and c.known[j]:
                    out["tie", kind, int(c.labels[i] == c.labels[j])] += 1
    return out


def train(texts: list[str]) -> SkipChain:
    return fit_counts(tally(texts))


def fit_counts(found: Counter, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> SkipChain:
    """Piecewise: nodes by weighted softmax regression, edges by smoothed counts of label pairs."""
    size = OTHER + 1
    nodes = sorted((k[1], k[2], n) for k, n in found.items() if k[0] == "node")
    node = np.zeros((len(features("0")), size))
    if nodes:
        xs, target, weight = np.array([x for x, _, _ in nodes]), np.eye(size)[[y for _, y, _ in nodes]], np.array([n for _, _, n in nodes])[:, None]
        weight = weight / weight.sum()
        for _ in range(steps):
            z = xs @ node
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            node -= rate * (xs.T @ (weight * (p - target)) + ridge * node)
    pairs = np.ones((size, size))
    agree = np.full((len(TIES), 2), PRIOR)
    for k, n in found.items():
        if k[0] == "chain":
            pairs[k[1], k[2]] += n
        elif k[0] == "tie":
            agree[k[1], k[2]] += n
    agree += SMOOTH * agree.sum(axis=1, keepdims=True)
    pairs /= pairs.sum()
    chain = np.log(pairs) - np.log(pairs.sum(axis=1))[:, None] - np.log(pairs.sum(axis=0))[None, :]
    same = agree[:, 1] / agree.sum(axis=1)
    skip = np.where(np.eye(size, dtype=bool), np.log(same)[:, None, None], np.log((1 - same) / (size - 1))[:, None, None])
    return SkipChain(node, np.clip(chain, -1, 1), skip)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> SkipChain:
    """From all rows of a table: sums of counts alone come to the driver, at most one for each of the features' combinations."""

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for part in text_groups(batch):
                found.update(tally([t or "" for t in part.column(1).to_pylist()]))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(k) for k in found], pa.string()), pa.array([float(n) for n in found.values()], pa.float64())], ["key", "n"])

    # numbers are multiples of a half, whose sums are exact in any order
    rows = docs.select(F.lit(0), text).mapInArrow(run, "key string, n double").groupBy("key").agg(F.sum("n").alias("n")).collect()
    found: Counter = Counter()
    for key, n in sorted(rows):
        kind, a, b = json.loads(key)
        found[kind, tuple(a) if isinstance(a, list) else a, b] += n
    return fit_counts(found)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: SkipChain | None = None) -> DataFrame:
    """One row a document: counts by kind, base_sha256, and spans of all kinds."""
    field = model or fit(docs, doc_id, text)

    def rows(texts: list[str]):
        for t in texts:
            base = base_spans(t)
            more = field.spans(t, base) if DIGIT.search(t) or "@" in t else []
            n = [0] * OTHER
            for _, k, _ in base:
                n[k] += 1
            yield *n, hashlib.sha256(span_text(base, KINDS).encode()).hexdigest(), span_text(base + more, KINDS), len(more)

    long, string = pa.int64(), pa.string()
    return map_texts(docs, doc_id, text, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", rows, [long] * 4 + [string, string, long])


def op6_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
