"""Shared helpers of the training-data operators: table access, small Arrow
batches, stored intermediate tables, and vectorised word hashing over the raw
UTF-8 bytes of a batch of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import scratch_path

#: Rows per Arrow batch sent to a Python worker; texts may be long.
BATCH_ROWS = 512
#: Bytes of text handled at a time inside a worker (a longer text is one chunk).
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size, so that a batch of long texts
    stays small in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the cluster's shared folder and read it back:
    later jobs start from the files, whichever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hex_digest_of_list(items: Column) -> Column:
    """Lowercase SHA-256 hex of the comma-joined strings."""
    return F.sha2(F.concat_ws(",", items), 256)


class BitTable:
    """A table of bits that lets all hashes of a one-column DataFrame through,
    and few others; sent to all tasks, so its size has fixed bounds (2^20 to
    2^26 bits, 8 MB)."""

    LEAST_BITS, MOST_BITS = 20, 26

    def __init__(self, hashes: DataFrame):
        hashes = hashes.toDF("hash")
        n = max(1, hashes.count())
        self.log = int(min(self.MOST_BITS, max(self.LEAST_BITS, np.ceil(np.log2(n * 64)))))
        words = (hashes.select(F.shiftrightunsigned("hash", 64 - self.log).alias("bit"))
                 .select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("b"))
                 .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
        self.table = np.zeros(1 << (self.log - 6), np.uint64)
        self.table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(64 - self.log)
        return (self.table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


# --------------------------------------------------------------------------
# Texts of a batch as bytes
# --------------------------------------------------------------------------

def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (or the bytes of a binary column) and the n + 1
    offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(o[-1] - o[0]), int(o[0])), o - o[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


#: Bytes of the words [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (lower-cased).
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

# --------------------------------------------------------------------------
# Polynomial hashes modulo 2^64
# --------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, kept by the worker."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers, _inverse_powers = (
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
            for b in (_BASE, _INVERSE))
    return _powers, _inverse_powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of the first i bytes."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, equal for equal bytes wherever they stand."""
    _, inverse = powers(len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


def word_bounds(data: np.ndarray, offsets: np.ndarray, members: np.ndarray):
    """Starts and ends of all words, and the index of each text's first word
    (n + 1 entries); a word never crosses texts."""
    inside = members[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Polynomials modulo 2^64 collide on known strings of some hundred bytes and more, so
#: longer words than this are hashed by BLAKE2.
POLYNOMIAL_BYTES = 128


def long_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit BLAKE2 hashes of the byte ranges."""
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little")
                     for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = range_hashes(prefix_hashes(data), starts, ends)
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(ends - starts > POLYNOMIAL_BYTES)
    if len(long):
        h[long] = long_hashes(data.tobytes(), starts[long], ends[long])
    return h


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int):
    """Hashes of all runs of ``size`` words within one text, in order, and the
    index of each text's first run (n + 1 entries). ``words`` are word hashes,
    ``first`` the index of each text's first word."""
    counts = np.diff(first)
    runs = np.maximum(counts - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(runs)])
    index = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], runs)
    h = np.zeros(len(index), np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + words[index + i])
    return mix(h + np.uint64(size)), at, index
