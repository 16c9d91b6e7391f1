"""What operators on words share inside of tasks: words of many texts as one Arrow array, radix sort, packed keys, bit maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bit map of keys, whatever their number: 4 MiB.
BITS = 1 << 25
#: Odd multipliers that spread 64 bits.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def kinds(word: bytes, breaks: bytes = b"") -> bytes:
    """A table for bytes.translate: 1 for bytes of words, 2 for breaks, 0 for what separates words only."""
    return bytes(1 if b in word else 2 if b in breaks else 0 for b in range(256))


def runs_of_words(data: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, which begins and ends outside of words, and where breaks are."""
    kind = np.frombuffer(data.translate(table), np.uint8)
    inside = kind == 1
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[0::2], edges[1::2], np.flatnonzero(kind == 2)


def as_array(flat: bytes | np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values of these lengths, one after the other in ``flat``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread so that any of them can number partitions or bits of a map."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of 64-bit keys: four stable counting passes over 16 bits each, lowest first."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in (16, 32, 48):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of spread 64-bit keys each lies in; 65,536 ranges at most."""
    return ((keys >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int32)


def parts_for(df: DataFrame, rows: int, each: int) -> int:
    """Partitions of about ``each`` rows, no fewer than the session's shuffle partitions."""
    return min(1 << 16, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // each))


def starts_of_runs(same_as_before: np.ndarray, n: int) -> np.ndarray:
    """Where runs start among ``n`` sorted rows, given for each row but the first whether it equals the one before."""
    return np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), ~same_as_before]))


def places(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each mark in a bit map."""
    return marks & np.uint64(BITS - 1), (marks >> np.uint64(32)) & np.uint64(BITS - 1)


def may_hold(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether marks may be among those the map was made of: all that are, and few others unless there are very many."""
    a, b = places(marks)
    bit = lambda x: (bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1
    return (bit(a) & bit(b)).astype(bool)


def bit_map(df: DataFrame, mark: str) -> np.ndarray:
    """The map of a column of 64-bit marks, put together on the executors by blocks of 4 KiB: 4 MiB at any size."""
    low, high = F.col(mark).bitwiseAND(BITS - 1), F.shiftrightunsigned(F.col(mark), 32).bitwiseAND(BITS - 1)
    bit = df.select(F.explode(F.array(low, high)).alias("b")).select((F.col("b") + 1).alias("b"))
    blocks = bit.groupBy(F.bitmap_bucket_number("b").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for block, found in blocks:
        at = (block - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(found), np.uint8)
    return out
