"""Vectorised text kernels: whole Arrow batches to word, shingle and line hashes in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, after lower-casing A-Z; in UTF-8 this equals the code-point rule
``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit polynomial sums over random byte values, finished with an avalanche mix, so
that every word of a batch costs a few array passes and no Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SHINGLE_WORDS = 5
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20250101)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_WORD_MULT = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table is kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
        table[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(table)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser (a bijection of 64-bit words)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``limit`` bytes of text each; one longer text makes a slice of its own."""
    _, off = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word and, per text, the index of its first word (length texts + 1)."""
    n = len(raw)
    if n == 0:
        none = np.empty(0, np.int64)
        return np.empty(0, U64), none, none, np.zeros(len(off), np.int64)
    data = LOWER[raw] if lower else raw
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(data, start, end), start, end, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each span, equal for equal bytes wherever they stand."""
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUE[data] * _power(_BASE, len(data)), out=total[1:])
        poly = (total[end] - total[start]) * _power(_BASE_INV, len(data) + 1)[start]
        return mix(poly + (end - start).astype(U64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words per text and, per text, the index of its first one.

    A text of 1 to ``size - 1`` words has one shingle, its whole sequence; a text without words has none.
    """
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(bounds[-1], U64)
    with np.errstate(over="ignore"):
        if len(words) >= size:
            full = np.zeros(len(words) - size + 1, U64)
            for j in range(size):
                full += words[j : len(full) + j] * _WORD_MULT[j]
            long = count >= size
            pick = np.repeat(first[:-1][long] - bounds[:-1][long], made[long]) + _ranges(bounds[:-1][long], made[long])
            out[_ranges(bounds[:-1][long], made[long])] = full[pick]
        for i in np.flatnonzero((count > 0) & (count < size)):
            w = words[first[i] : first[i + 1]]
            out[bounds[i]] = (w * _WORD_MULT[: len(w)]).sum(dtype=U64) + U64(len(w))
    return mix(out), bounds


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., start[1], ...: the ranges one after the other."""
    if len(start) == 0:
        return np.empty(0, np.int64)
    return np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())


def text_shingles(column: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (repeats included) of each text of an Arrow column, with bounds."""
    raw, off = text_bytes(column)
    words, _, _, first = word_hashes(raw, off)
    return shingle_hashes(words, first, size)


def as_i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
