"""Vectorised word scanning over Arrow string buffers.

A column of texts is read as one flat UTF-8 byte array with document offsets, so that finding words and
hashing them takes a handful of numpy passes and never makes a Python string.  Everything here is exact on
bytes: delimiters are ASCII, and no ASCII byte occurs inside a multi-byte UTF-8 sequence.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text worked on at a time, and texts at most, for tables of very short ones; a longer text forms a slice of its own.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1024
#: Bytes hashed at a time inside a slice.
SEGMENT_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def keyed(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(0x10001)) * U64(0x9E3779B97F4A7C15))


_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = keyed(256, 11)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT_BYTES + 1024)
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 8 * SEGMENT_BYTES:
            _powers[base] = have
    return have


class Words(NamedTuple):
    """Word i is data[start[i]:end[i]]; document d has the words first[d] to first[d + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def trim() -> None:
    """Give memory that numpy has freed back to the system: several workers share a machine, and each lives long."""
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes of text, SLICE_ROWS at most, each with its bytes and offsets."""
    data, at = buffers(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(i + SLICE_ROWS, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    if len(data) > SLICE_BYTES:
        trim()


def spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, and each document's first word."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint spans; fold: A-Z count as a-z."""
    table, out, lo, n = _FOLD if fold else _BYTE, np.empty(len(start), U64), 0, len(start)
    while lo < n:
        s0 = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, s0 + SEGMENT_BYTES, "right")))
        seg = data[s0 : int(end[hi - 1])]
        sums = np.zeros(len(seg) + 1, U64)
        np.cumsum(table[seg] * _power(_P, len(seg))[: len(seg)], out=sums[1:])
        s, e = start[lo:hi] - s0, end[lo:hi] - s0
        out[lo:hi] = mix64((sums[e] - sums[s]) * _power(_P_INV, len(seg))[s] + (e - s).astype(U64))
        lo = hi
    return out


def hash_of(text: str | bytes, fold: bool = False) -> int:
    """The hash that hashes() gives a span with these bytes."""
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]), fold)[0])


def words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = NOT_SPACE, fold: bool = False) -> Words:
    start, end, first = spans(data, at, is_word)
    return Words(start, end, first, hashes(data, start, end, fold))


def windows(word_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` consecutive words of one document, and the place of each one's first word."""
    n = len(word_hash)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    base = 0x9FB21C651E98DF25
    inverse = pow(base, -1, 1 << 64)
    out = np.empty(n - size + 1, U64)
    for lo in range(0, n - size + 1, SEGMENT_BYTES):
        hi = min(lo + SEGMENT_BYTES, n - size + 1)
        part = word_hash[lo : hi + size - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * _power(base, len(part))[: len(part)], out=sums[1:])
        k = np.arange(hi - lo)
        out[lo:hi] = mix64((sums[k + size] - sums[k]) * _power(inverse, len(part))[k] + U64(size))
    place = np.arange(n - size + 1)
    left = np.repeat(first[1:], np.diff(first))[: n - size + 1]
    ok = place + size <= left
    return out[ok], place[ok]
