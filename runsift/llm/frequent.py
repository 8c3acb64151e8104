"""Which keys occur often: counted by hash over all rows, kept as a filter of fixed size that never misses one.

Tasks send their hashes as sorted blocks, one row per bucket with 24 bits and a small count per key. Buckets grow in
number with the input, so merging one stays small. The keys that reach the least count set bits in a table of
``2 ** BITS`` bits (16 MB), whatever the input. The filter may let rare keys pass, more of them once some ten million
keys and more are frequent; callers count exactly behind it, so results never depend on that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm.words import mix

BITS = 27
PROBES = 3
PAGE = 1 << 16  # bytes of the bit table that travel as one row
PIECE = 1 << 17  # keys looked up together
BUCKET_BYTES = 8 << 20  # text per bucket, about
KEY_BLOCKS = "bucket int, keys binary, counts binary"
_U = np.uint64


def bucket_bits(docs: DataFrame, text: Column) -> int:
    """log2 of the number of buckets, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(31, max(0, int(total // BUCKET_BYTES).bit_length()))


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in a sorted array."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def planes(values: np.ndarray, width: int) -> bytes:
    """The last ``width`` bytes of whole numbers, all first bytes first: sorted or small numbers then compress well."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:].T).tobytes()


def from_planes(data, width: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, 8 - width:] = rows.T
    return out.view(">u8").ravel().astype(_U)


def pack(hashes: np.ndarray, bits: int, least: int) -> pa.RecordBatch:
    """Sorted blocks of the distinct hashes; counts stop at ``least``, which is all that the merge asks."""
    short = np.sort(hashes >> _U(40 - bits))
    at = runs(short)
    counts = np.minimum(np.diff(np.append(at, len(short))), least).astype(np.uint8 if least < 256 else np.int32)
    short = short[at]
    buckets = (short >> _U(24)).astype(np.int32)
    cut = runs(buckets)
    ends = np.append(cut, len(short))[1:]
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[cut]), pa.array([planes(short[a:b], 3) for a, b in zip(cut, ends, strict=True)], pa.binary()),
         pa.array([counts[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
        ["bucket", "keys", "counts"])


def _positions(short: np.ndarray) -> Iterator[np.ndarray]:
    for j in range(PROBES):
        yield mix(short + _U(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))) >> _U(64 - BITS)


def _mark(table: np.ndarray, short: np.ndarray) -> None:
    for where in _positions(short):
        np.bitwise_or.at(table, (where >> _U(3)).astype(np.int64), (_U(1) << (where & _U(7))).astype(np.uint8))


def _merge(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (BITS - 3), np.uint8)
        now, keys, counts = None, [], []

        def settle() -> None:
            if keys:
                k, c = np.concatenate(keys), np.concatenate(counts)
                order = np.argsort(k, kind="stable")
                k = k[order]
                at = runs(k)
                often = k[at][np.add.reduceat(c[order].astype(np.int64), at) >= least]
                _mark(table, (_U(now) << _U(24)) | often)
            keys.clear()
            counts.clear()

        for batch in batches:
            for bucket, k, c in zip(*[batch.column(i) for i in range(3)], strict=True):
                if bucket.as_py() != now:
                    settle()
                    now = bucket.as_py()
                keys.append(from_planes(k.as_buffer(), 3))
                counts.append(np.frombuffer(c.as_buffer(), np.uint8 if least < 256 else np.int32))
        settle()
        pages = table.reshape(-1, PAGE)
        used = np.flatnonzero(pages.any(1))
        for p in used:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pages[p].tobytes()], pa.binary())],
                                             ["page", "bytes"])
    return run


def _union(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, bits = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["page", "bytes"])

    for batch in batches:
        for page, more in zip(batch.column(0), batch.column(1), strict=True):
            if page.as_py() != now:
                if now is not None:
                    yield row()
                now, bits = page.as_py(), np.zeros(PAGE, np.uint8)
            bits |= np.frombuffer(more.as_buffer(), np.uint8)
    if now is not None:
        yield row()


class Filter:
    """Bits of the frequent keys. ``likely`` is true for each of them, and for few others."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(1 << (BITS - 3), np.uint8)

    def __getstate__(self) -> tuple:
        return self.bits, zlib.compress(self.table, 1)  # mostly zeros while few keys are frequent

    def __setstate__(self, state: tuple) -> None:
        self.bits, self.table = state[0], np.frombuffer(zlib.decompress(state[1]), np.uint8)

    def likely(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for low in range(0, len(hashes), PIECE):
            own = out[low:low + PIECE]
            for where in _positions(hashes[low:low + PIECE] >> _U(40 - self.bits)):
                own &= (self.table[(where >> _U(3)).astype(np.int64)] >> (where & _U(7)).astype(np.uint8)) & 1 == 1
        return out

    def put(self, hashes: np.ndarray) -> None:
        _mark(self.table, hashes >> _U(40 - self.bits))

    def add(self, other: Filter) -> Filter:
        self.table |= other.table
        return self

    def learn(self, blocks: DataFrame, least: int) -> Filter:
        """Add the keys of ``blocks`` (rows of ``pack``) that occur ``least`` times or more. At most 16 MB reach the driver."""
        merged = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge(least), "page int, bytes binary")
        pages = merged.repartition("page").sortWithinPartitions("page").mapInArrow(_union, "page int, bytes binary").toArrow()
        for page, more in zip(pages["page"], pages["bytes"], strict=True):
            at = page.as_py() * PAGE
            self.table[at:at + PAGE] |= np.frombuffer(more.as_buffer(), np.uint8)
        return self
