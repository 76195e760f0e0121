"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

Texts of a batch lie behind one another in one byte array, so that word, line and window hashes of many documents
come from a few numpy passes. Batches are cut into slices of bounded size; a text is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: Longer spans get a cryptographic digest: polynomials modulo 2^64 take different sequences of some thousand bytes for equal.
POLYNOMIAL_BYTES = 256
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1, from 0) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.cast(kind).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `limit` bytes together; a longer text comes alone."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or _powers[0].size < n:
        size = max(n, SLICE_BYTES + 1024)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


class Spans:
    """Hashes of any byte spans of one buffer: up to POLYNOMIAL_BYTES by prefix sums of a polynomial modulo 2^64 over random byte values,
    beyond that by 64 bits of BLAKE2."""

    def __init__(self, raw: np.ndarray):
        n = raw.size
        self._raw = raw
        power, self._inverse = _power_tables(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[:n], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self._sums[end] - self._sums[start]) * self._inverse[start]
        out = mix64(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for k in np.flatnonzero(end - start > POLYNOMIAL_BYTES):
            out[k] = int.from_bytes(hashlib.blake2b(self._raw[start[k] : end[k]], digest_size=8).digest(), "little")
        return out

    def whole(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bare polynomials of spans, which `without` compares with: equal for equal bytes, not always different for others."""
        return (self._sums[end] - self._sums[start]) * self._inverse[start]

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The polynomials of spans that lack the byte `at`."""
        return (self._sums[at] - self._sums[start]) * self._inverse[start] + (self._sums[end] - self._sums[at + 1]) * self._inverse[start + 1]

    def windows(self, width: int) -> np.ndarray:
        """Of every window of `width` bytes, by its start."""
        n = self._sums.size - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self._sums[width:] - self._sums[:n]) * self._inverse[:n])


def is_space(raw: np.ndarray) -> np.ndarray:
    """Bytes of [\\x20\\x09-\\x0D]."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word [^\\x20\\x09-\\x0D]+, and for each row the index of its first word (rows + 1)."""
    inside = ~is_space(raw)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < raw.size)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)
