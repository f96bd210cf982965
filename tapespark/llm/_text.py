"""Vectorised text primitives used inside tasks: byte views of Arrow strings, word hashes, rolling n-gram hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: One slice of a batch holds about this many bytes (a longer text makes a slice of its own).
SLICE_BYTES = 1 << 20
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


#: A random value for each byte; A-Z share the values of a-z, so hashes ignore ASCII case.
_EXACT = mix(np.arange(1, 257, dtype=U))
_BYTE = _EXACT.copy()
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Powers of the base and of its inverse, for blocks of ``SLICE_BYTES``.
_UP = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(SLICE_BYTES, _BASE, U))))
_DOWN = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(SLICE_BYTES, _BASE_INV, U))))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


def cut_long(raw: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes, each ending before white space; a word longer than that stays whole."""
    a, n = 0, len(raw)
    while a < n:
        b = min(a + limit, n)
        while b < n:
            at = np.flatnonzero(_SPACE[raw[b : b + limit]])
            if len(at):
                b += int(at[0])
                break
            b = min(b + limit, n)
        yield a, b
        a = b


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows: (start byte, end byte, 64-bit hash, first word of each row and the total)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(off), np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = off[1:][off[1:] > 0] - 1
    last[edges] = inside[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, hash_ranges(raw, start, end), np.searchsorted(start, off)


def hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, exact: bool = False) -> np.ndarray:
    """64-bit hash of each range of bytes, the ranges in order and apart; ASCII case counts only if ``exact``.

    Blocks of at most ``SLICE_BYTES`` are hashed at a time, so that a long text needs no more memory than a short one.
    """
    table = _EXACT if exact else _BYTE
    out = np.empty(len(start), U)
    k = 0
    while k < len(start):
        a = int(start[k])
        j = max(k + 1, int(np.searchsorted(end, a + SLICE_BYTES, "right")))
        if int(end[j - 1]) - a > SLICE_BYTES:
            out[k] = _long_sum(table, raw[a : int(end[k])])
        else:
            total = np.zeros(int(end[j - 1]) - a + 1, U)
            np.cumsum(table[raw[a : int(end[j - 1])]] * _UP[: len(total) - 1], out=total[1:])
            out[k:j] = (total[end[k:j] - a] - total[start[k:j] - a]) * _DOWN[start[k:j] - a]
        k = j
    return mix(out + (end - start).astype(U))


def _long_sum(table: np.ndarray, raw: np.ndarray) -> np.uint64:
    """The sum that ``hash_ranges`` takes, of one range longer than a block."""
    total = np.zeros(1, U)
    for a in range((len(raw) - 1) // SLICE_BYTES * SLICE_BYTES, -1, -SLICE_BYTES):
        part = raw[a : a + SLICE_BYTES]
        total = total * _UP[SLICE_BYTES] + (table[part] * _UP[: len(part)]).sum(dtype=U)
    return total[0]


def shingles(value: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words in each row (a shorter row: its whole sequence as one), and where each row's begin."""
    counts = np.diff(first)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(each)))
    row = np.repeat(np.arange(len(counts)), each)
    at = first[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    left = counts[row]
    out = np.full(len(at), U(size), U)
    for k in range(size):
        there = left > k
        picked = value[np.where(there, np.minimum(at + k, max(len(value) - 1, 0)), 0)] if len(value) else np.zeros(0, U)
        out = np.where(there, mix(out * U(0x9E3779B97F4A7C15) + picked), out)
    return out, begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in rising order, and where each row's begin."""
    if len(values) == 0:
        return values, np.zeros(len(begin), np.int64)
    values = values.copy()
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[begin[:-1][begin[:-1] < len(values)]] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[begin]
