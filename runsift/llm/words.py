"""Words of whole texts as numpy arrays: a few passes over the bytes of an Arrow batch, no Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19  # bytes handled at once; a longer text is a chunk of its own
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _table(inside: list[int]) -> bytes:
    return bytes(b in set(inside) for b in range(256))


def look_up(data: np.ndarray, table: bytes) -> np.ndarray:
    """Each byte replaced by its entry in a 256-byte table."""
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


#: Anything but space and the five ASCII controls from tab to carriage return.
NON_BLANK = _table([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = _table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = bytes(range(256)).lower()
_BASE = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, _U)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=_U)
    return have


class Chunk(NamedTuple):
    """Some consecutive rows of a batch: their bytes and where each row's bytes begin."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """``hashes``, ``starts``, ``ends``: of each word; words of row r are ``rows[r]:rows[r + 1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``size`` bytes; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        yield Chunk(low, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        low = high


def prefix_hash(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of value * base**position, with a leading zero; all modulo 2**64."""
    sums = np.empty(len(values) + 1, _U)
    sums[0] = 0
    np.cumsum((values.astype(_U) + _U(0x9E3779B97F4A7C15)) * _power(base, len(values))[:len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of the values from start to end, the same wherever they stand."""
    inverse = pow(base, -1, 1 << 64)
    return (sums[ends] - sums[starts]) * _power(inverse, len(sums))[starts]


def words(chunk: Chunk, table: bytes) -> Words:
    """Words are maximal runs of bytes in ``table``; A-Z and a-z hash alike."""
    data, offsets = chunk.data, chunk.offsets
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = look_up(data, table)
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    filled = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[head] = inside[1:-1][head]
    ends[tail] = inside[1:-1][tail]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = mix(span_hash(prefix_hash(look_up(data, LOWER)), starts, stops))
    return Words(hashes, starts, stops, np.searchsorted(starts, offsets))


def windows(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``width`` words that stays inside its row."""
    counts = np.diff(found.rows)
    n = len(found.hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    last = np.repeat(found.rows[1:], counts)
    first = np.flatnonzero(np.arange(n) + width <= last)
    total = np.zeros(n - width + 1, _U)
    for j in range(width):
        total = total * _U(0x9FB21C651E98DF25) + found.hashes[j:n - width + 1 + j]
    return first, mix(total[first] + _U(width))


def row_of(found: Words) -> np.ndarray:
    """Row of every word."""
    return np.repeat(np.arange(len(found.rows) - 1), np.diff(found.rows))


def of_text(text: bytes, table: bytes) -> Words:
    data = np.frombuffer(text, np.uint8)
    return words(Chunk(0, data, np.array([0, len(data)])), table)
