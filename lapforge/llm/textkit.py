"""Vectorised text primitives that tasks share: UTF-8 views, words, hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, np.ndarray] = {}

#: Bytes of text that one pass of the kernels holds; a longer text is a pass of its own.
PASS_BYTES = 500_000


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES):
    """Ranges of rows (i, j) of about limit bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _powers(n: int, base: int, key: int) -> np.ndarray:
    have = _tables.get(key)
    if have is None or len(have) < n:
        size = max(n, PASS_BYTES + 1)
        have = np.full(size, base % (1 << 64), U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _tables[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each row's words) for one pass.

    A word is a maximal run of bytes outside space; with lower, A-Z count as a-z. Equal words have
    equal 64-bit hashes.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(((_LOWER[data] if lower else data).astype(U64) + U64(1)) * _powers(n, _P, 1), out=total[1:])
        raw = (total[ends] - total[starts]) * _powers(n, _P_INVERSE, 2)[starts]
        hashed = mix(raw ^ ((ends - starts).astype(U64) << U64(56)))
    return hashed, np.searchsorted(starts, offsets)


def shingles(hashed: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of size words (the rows of a pass run on; callers cut them)."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out *= U64(0xD1342543DE82EF95)
            out += hashed[k : k + n]
            out ^= out >> U64(29)
    return mix(out)


def sequence_hash(hashed: np.ndarray) -> int:
    """One hash of a whole word sequence and its length."""
    h = 0x243F6A8885A308D3 + len(hashed)
    for x in hashed.tolist():
        h = ((h ^ x) * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h
