"""Array kernels over batches of texts: words, word hashes and shingles without a Python loop over words.

Texts come as Arrow string columns; their UTF-8 bytes are worked on in slices of about a megabyte, so that
memory does not depend on the size of a batch (one very long text makes a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Words of more bytes than this get a cryptographic hash instead of a polynomial one.
LONG_WORD = 256

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of each row in the bytes) of consecutive slices; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + slice_bytes, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, every[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (in place where it can be)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_POWERS: list[np.ndarray] = [np.zeros(0, U64), np.zeros(0, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                p = np.full(size, base, dtype=U64)
                p[0] = 1
                _POWERS[k] = np.multiply.accumulate(p, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def spans(marks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of ``marks`` that stay within one row."""
    n = len(marks)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    starts = np.empty(n, bool)
    starts[0] = marks[0]
    np.logical_and(marks[1:], ~marks[:-1], out=starts[1:])
    inner = offsets[1:-1]
    inner = inner[inner < n]
    starts[inner] = marks[inner]
    ends = np.empty(n, bool)
    ends[-1] = marks[-1]
    np.logical_and(marks[:-1], ~marks[1:], out=ends[:-1])
    last = inner[inner > 0] - 1
    ends[last] = marks[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(buf) + 1, U64)
        total[0] = 0
        np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h = fmix(h ^ ((ends - starts).astype(U64) << U64(56)))
    long = np.flatnonzero(ends - starts > LONG_WORD)
    for i in long:
        h[i] = int.from_bytes(blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each white-space delimited word."""
    return spans(~IS_SPACE[buf], offsets)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the items of each of ``n`` rows begin in a list sorted by row (n + 1 bounds)."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of every row, sorted within the row, and their n + 1 bounds.

    A row with words but fewer than ``width`` has one shingle, its whole sequence; one without words has none.
    """
    n = len(offsets) - 1
    buf = LOWER[buf]
    s, e, row = words(buf, offsets)
    h = span_hashes(buf, s, e)
    bounds = row_bounds(row, n)
    counts = np.diff(bounds)
    with np.errstate(over="ignore"):
        m = max(len(h) - width + 1, 0)
        rolled = np.zeros(m, U64)
        for k in range(width):
            rolled = fmix(rolled * U64(0x2545F4914F6CDD1D) + h[k : k + m] + U64(k + 1))
        inside = np.zeros(m, bool)
        if m:
            inside = row[:m] == row[width - 1 : width - 1 + m]
        values, owners = rolled[inside], row[:m][inside]
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            extra = np.empty(len(short), U64)
            for i, r in enumerate(short):
                v = U64(0xA5A5)
                for w in h[bounds[r] : bounds[r + 1]]:
                    v = fmix(np.array([v * U64(0x2545F4914F6CDD1D) + w + U64(977)], U64))[0]
                extra[i] = v
            values, owners = np.concatenate([values, extra]), np.concatenate([owners, short])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    if len(values):
        fresh = np.empty(len(values), bool)
        fresh[0] = True
        np.logical_or(values[1:] != values[:-1], owners[1:] != owners[:-1], out=fresh[1:])
        values, owners = values[fresh], owners[fresh]
    return values, row_bounds(owners, n)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments; empty ones are 0.  Sums are taken per segment, so a row's result does not
    depend on its neighbours."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out
