"""Vectorised word kernel over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the
same as `[^\\x20\\x09-\\x0D]+` over code points because UTF-8 never uses those
bytes inside a longer character.  Everything works on whole texts; work arrays
are bounded by BLOCK bytes of text, except that one document is never split
between calls.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 4 << 20
HASH_BLOCK = 1 << 19  # bytes that are hashed at once, eight bytes of work space each, several times
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i below n, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); returns a new array."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


@dataclass
class Words:
    """Words of several texts: byte ranges in data, 64-bit hashes, and the first word of each text."""

    data: np.ndarray  # bytes of all texts, folded if asked for
    offsets: np.ndarray  # of each text in data, one more than texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than texts

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, lower: bool = True, space: np.ndarray = SPACE) -> Words:
    """The words of each text: runs of bytes that are not space."""
    data, offsets = utf8(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    ink = ~space[data]
    begin = np.ones(n + 1, bool)
    begin[1:n] = ~ink[:-1]
    begin[offsets] = True
    start = np.flatnonzero(ink & begin[:n])
    end = np.flatnonzero(ink & (begin[1:] | np.append(~ink[1:], True)[:n])) + 1
    return Words(data, offsets, start, end, _hashes(data, start, end), np.searchsorted(start, offsets))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        at = start[i]
        j = max(i + 1, int(np.searchsorted(end, at + HASH_BLOCK, "right")))
        n = int(end[j - 1] - at)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data[at : at + n]] * _power(_BASE, n), out=sums[1:])
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * _power(_INVERSE, n)[s] + (e - s).astype(U64))
        i = j
    return out


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, also for runs that cross texts; len(hashes) - n + 1 of them."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(hashes) - n + 1, U64)
    for k in range(n):
        out = (out + hashes[k : k + len(out)]) * U64(0xD6E8FEB86659FD93 + 2 * k)
        out ^= out >> U64(32)
    return mix(out)


def return_memory() -> None:
    """Gives free memory back to the system, which keeps a worker at what it uses now rather than at what it once used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most limit bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(utf8(batch.column(batch.schema.get_field_index(column)))[1]))
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
            yield batch.slice(i, j - i)
            i = j
        return_memory()


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about limit bytes of text: small ones are put together, large ones cut as slices() does."""
    held, size = [], 0
    for batch in slices(batches, column, limit):
        n = int(utf8(batch.column(batch.schema.get_field_index(column)))[1][-1])
        if held and size + n > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.concat_batches(held)
