"""Vectorised work on batches of UTF-8 text: word spans, word hashes and window hashes in numpy.

All functions see one flat byte array plus document offsets, as Arrow stores a string column, so no
Python object is made for a word. Blocks hold whole documents; a block's memory is about sixty
times its bytes, so callers cut batches with ``blocks``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240229)
_RAW = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]

_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, BLOCK + 1)
        _powers = np.full(size, _BASE, _U)
        _inverses = np.full(size, _INVERSE, _U)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)) if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of whole documents of about ``size`` bytes: (first, last + 1, bytes, offsets)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't white space, and the offsets of each document's words."""
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = True
        before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | cut[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = True
        after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes; with ``lower``, A-Z count as a-z."""
    powers, inverses = _tables(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((_LOWER if lower else _RAW)[data] * powers[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(_U))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` word hashes, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(width):
        out = out * _U(_BASE) + mix(words[k : k + n] + _U(k + 1))
    return mix(out)


def set_hash(sorted_hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a set of hashes."""
    n = _U(len(sorted_hashes))
    parts = np.array([np.bitwise_xor.reduce(mix(sorted_hashes + n)), np.add.reduce(sorted_hashes), n], _U)
    return int(window_hashes(parts, 3).view(np.int64)[0])


def text_hash(word: str, lower: bool = False) -> int:
    """``span_hashes`` of one word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(b, np.zeros(1, np.int64), np.array([len(b)]), lower)[0])
