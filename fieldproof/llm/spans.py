"""Runs of bytes in whole Arrow batches: the words and terms of :mod:`.phrases` and :mod:`.divergence`, as local ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernels as K


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 truths, true inside the ranges (both ends included)."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


def runs(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each longest run of bytes of the class ``inside``; a run ends where its text ends."""
    within = inside[raw]
    first, last = within.copy(), within.copy()
    first[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] |= within[cut]
    last[cut - 1] |= within[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, side="right") - 1


def named(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each span, equal for equal bytes, and the bytes of each number. Spans don't overlap."""
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    data = raw[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pc.dictionary_encode(words)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value of a string column without nulls, and the value of each number."""
    out = pc.dictionary_encode(column)
    return out.indices.to_numpy(zero_copy_only=False).astype(np.int64), out.dictionary


def value_hashes(values: pa.Array) -> np.ndarray:
    """The hash of :func:`.kernels.span_hashes` for each value."""
    raw, off = K.text_bytes(values)
    return K.span_hashes(raw, off[:-1], off[1:]) if len(raw) else K.mix(np.zeros(len(values), K.U64))
