"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives vocabulary and merges: every split of a token into two tokens is a merge, in the
order of the token's rank, which is how ranks alone define byte-pair merging. Texts are cut by the
pattern; the pieces of a group of texts (some megabytes of an Arrow batch, or one longer text) are
numbered, each distinct one has its bytes mapped to characters and is encoded once by the library's
model, and a text's ids are its pieces' ids in order. Nothing outlives its group. Whole texts are encoded.

The pattern runs in the regex module. Where a text holds a character that this Python's Unicode tables
do not assign, of which modules may think differently, the library's own splitter cuts it.

Decoding reverses the byte table; ids whose bytes end within a character are joined as bytes before
any character is formed. Defined results: null text is empty and has no ids; empty tables give empty
results; repeated rows are encoded each; a very long text needs memory in proportion to its own length;
other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, text_groups


def default_vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public multilingual vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def byte_table() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


@dataclass
class Encoded:
    """A group of texts: the number of each piece by text, and the ids of each number."""

    texts: list[array]
    ids: list[list[int]]

    def __iter__(self) -> Iterator[list[int]]:
        for numbers in self.texts:
            yield [i for k in numbers for i in self.ids[k]]


class Codec:
    """Encoder and decoder of one vocabulary; made once in each worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Regex, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.table = dict(enumerate(byte_table()))
        merges = [(self.spell(t[:i]), self.spell(t[i:])) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = models.BPE(vocab={self.spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.pattern = regex.compile(pattern)
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        byte_of = {c: b for b, c in self.table.items()}
        #: The byte table reversed, for each id.
        self.raw = {r: bytes(byte_of[c] for c in self.spell(t)) for t, r in ranks.items()}
        self.decimal = {r: str(r).encode() for r in self.raw}

    def spell(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.table)

    def pieces(self, text: str) -> Iterator[str]:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return iter([piece for piece, _ in self.splitter.pre_tokenize_str(text)])
        if len(text) < 1 << 20 and not self.pattern.groups:
            return iter(self.pattern.findall(text))
        return (m[0] for m in self.pattern.finditer(text))

    def encode(self, texts: list[str]) -> Encoded:
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__  # a new piece gets the next number
        found = [array("l", map(number.__getitem__, self.pieces(t))) for t in texts]
        ids_of = self.model.tokenize
        return Encoded(found, [[token.id for token in ids_of(self.spell(p.encode()))] for p in number])

    def offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and, for each, the span of characters that its bytes touch; a split character belongs to all its ids."""
        ids = next(iter(self.encode([text])))
        ends = np.cumsum([len(self.raw[i]) for i in ids], dtype=np.int64)
        # the number of the character that each byte belongs to: continuation bytes begin none
        at = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        starts = np.concatenate([[0], ends[:-1]]) if ids else ends
        return ids, list(zip(at[starts].tolist(), (at[ends - 1] + 1).tolist(), strict=True))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids: list[int], errors: str = "replace") -> str:
        return self.decode_bytes(ids).decode("utf-8", errors)

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: the number of ids, and SHA-256 of the decimal ids joined by commas, and of the decoded bytes."""
        found = self.encode(texts)
        size = list(map(len, found.ids))
        decimal = [b",".join(map(self.decimal.__getitem__, ids)) for ids in found.ids]
        raw = list(map(self.decode_bytes, found.ids))
        for numbers in found.texts:
            n = sum(map(size.__getitem__, numbers))
            shown, back = b",".join(map(decimal.__getitem__, numbers)), b"".join(map(raw.__getitem__, numbers))
            yield n, hashlib.sha256(shown).hexdigest(), hashlib.sha256(back).hexdigest()


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _mapped(df: DataFrame, schema: str, rows: Callable[[Codec, list], Iterator[tuple]], path: str | None, pattern: str | None) -> DataFrame:
    """``rows(codec, values)`` yields the new columns for each value of a group; the first column goes through."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_groups(batch):
                columns = zip(*rows(codec(path, pattern), [x if x is not None else "" for x in part.column(1).to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, out, strict=True))], names)

    fields = [x.split() for x in schema.split(",")]
    names = [df.columns[0], *(n for n, _ in fields)]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    out = [kinds[k] for _, k in fields]
    return df.mapInArrow(run, f"`{df.columns[0]}` {df.dtypes[0][1]}, {schema}")


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and the character span of each id (starts, ends)."""

    def rows(known: Codec, texts: list[str]) -> Iterator[tuple]:
        for t in texts:
            ids, spans = known.offsets(t)
            yield ids, [a for a, _ in spans], [b for _, b in spans]

    return _mapped(docs.select(doc_id, text), "ids array<int>, starts array<int>, ends array<int>", rows, path, pattern)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text; bytes that form no character become U+FFFD. Null ids give empty text."""
    return _mapped(encoded.select(doc_id, ids), "text string", lambda known, rows: ((known.decode(list(x)),) for x in rows), path, pattern)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by commas, and of the bytes that the ids decode to."""
    return _mapped(docs.select(doc_id, text), "n_tokens long, ids_sha256 string, decoded_sha256 string", Codec.digest, path, pattern)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
