"""Bytes, words and hashes of whole texts, a slab of documents at a time, in numpy.

A slab is some rows of an Arrow column whose texts hold about ``SLAB`` bytes together (or one
longer text), so the arrays of a task stay small whatever the batch or the table holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLAB = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPREAD = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*kept: range) -> np.ndarray:
    """Table of the bytes that belong to words."""
    table = np.zeros(256, dtype=bool)
    for span in kept:
        table[span.start : span.stop] = True
    return table


#: ``[^\\x20\\x09-\\x0D]+`` and ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after lower-casing); bytes from 0x80 are in both.
NOT_SPACE = byte_class(range(0, 9), range(14, 32), range(33, 256))
ALNUM = byte_class(range(48, 58), range(97, 123), range(128, 256))

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for the next slab."""
    if name not in _powers or len(_powers[name]) < n:
        out = np.full(max(n, SLAB + 4096), base, dtype=np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Polynomial prefix hashes of a byte array: the hash of any slice in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_SPREAD[data] * _power("up", BASE, n), out=self.prefix[1:])
        self._down = _power("down", _INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; equal slices have equal hashes wherever they stand."""
        return (self.prefix[ends] - self.prefix[starts]) * self._down[starts]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and where each row begins (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slabs(batch: pa.RecordBatch, column: str = "text", size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of about ``size`` (``SLAB``) bytes of text each, covering every row of the batch."""
    data, at = flat(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + (size or SLAB), side="right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    del data, at
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on for later stages, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Words:
    """Words of a slab: byte ``starts`` and ``ends``, and ``first``, the index of each row's first word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kept: np.ndarray):
        inside = kept[data]
        edge = np.ones(len(data), dtype=bool)
        if len(data):
            edge[1:] = ~inside[:-1]
            edge[at[:-1][at[:-1] < len(data)]] = True
        self.starts = np.flatnonzero(inside & edge)
        stop = np.ones(len(data), dtype=bool)
        if len(data):
            stop[:-1] = edge[1:] | ~inside[1:]
        self.ends = np.flatnonzero(inside & stop) + 1
        self.first = np.searchsorted(self.starts, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def hashes(self, prefix: PrefixHash) -> np.ndarray:
        return mix(prefix.of(self.starts, self.ends))

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, index of the first word) of every run of ``n`` words within a row."""
        m = len(hashes) - n + 1
        if m <= 0:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none
        total = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            total = total * BASE + hashes[k : k + m]
        whole = self.row[:m] == self.row[n - 1 :]
        at = np.flatnonzero(whole)
        return mix(total[at]), self.row[at], at


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of the distinct ``n``-word shingles of each row, lower-cased A-Z, by row and hash.

    With fewer words a row's whole sequence is its one shingle; without words it has none.
    """
    data = LOWER[data]
    words = Words(data, at, NOT_SPACE)
    hashes = words.hashes(PrefixHash(data))
    grams, rows, _ = words.grams(hashes, n)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for i, row in enumerate(short):
            total = int(counts[row])
            for h in hashes[words.first[row] : words.first[row + 1]].tolist():
                total = int(mix(np.array([(total * int(BASE) + h) % 2**64], dtype=np.uint64))[0])
            whole[i] = total
        grams, rows = np.concatenate([grams, whole]), np.concatenate([rows, short])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], grams[new]


def add_up(parts: DataFrame, sent: str, whole: str, salts: int = 256) -> DataFrame:
    """(block, values) of the tables that tasks send as (block, values): the sums of each block's arrays.

    ``sent`` and ``whole`` are the numpy types of what is sent and of the sums. Some of the tasks' parts
    are added first and the sums of those then, so no group grows with the number of tasks alone.
    """

    def adder(kind):
        def add(key, table):
            total = np.zeros(0)
            for x in table["values"]:
                part = np.frombuffer(x.as_buffer(), kind)
                total = part.astype(whole) if not len(total) else total + part
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([total.astype(whole).tobytes()], pa.binary())})

        return add

    some = parts.withColumn("salt", F.spark_partition_id() % salts)
    some = some.groupBy("block", "salt").applyInArrow(adder(sent), "block int, values binary")
    return some.groupBy("block").applyInArrow(adder(whole), "block int, values binary")


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal keys in sorted arrays."""
    n = len(keys[0])
    if not n:
        none = np.zeros(0, np.int64)
        return none, none
    new = np.ones(n, dtype=bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))
