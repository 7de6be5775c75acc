"""Vectorised scanning of Arrow text columns: words, their hashes and hashed word windows.

Texts stay UTF-8 bytes. A word is a maximal run of bytes outside the separators; since these are all
ASCII, bytes and code points split alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SLICE = 1 << 20
_POWERS: dict[int, np.ndarray] = {}

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, _SLICE + 1)
        known = np.empty(size, U64)
        known[0] = 1
        done, step = 1, base
        while done < size:
            k = min(done, size - done)
            known[done : done + k] = known[:k] * U64(step)
            done, step = done + k, step * step % (1 << 64)
        _POWERS[base] = known
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most about ``limit`` text bytes; a longer text is a batch of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        off = text_bytes(batch.column(batch.schema.get_field_index(text)))[1]
        at = 0
        while at < n:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def spans(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial from prefix sums, finalised. Works slice by
    slice, so that memory doesn't follow the longest text."""
    out = np.empty(len(starts), U64)
    inverse = U64(_P_INV)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
        piece = data[base : int(ends[to - 1])]
        power = _powers(_P, len(piece) + 1)
        sums = np.zeros(len(piece) + 1, U64)
        np.cumsum((piece.astype(U64) + U64(1)) * power[: len(piece)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * _powers(int(inverse), len(piece) + 1)[s]
        at = to
    return mix(out ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the ``n`` consecutive word hashes from each position on; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, U64)
    q = U64((0xC2B2AE3D27D4EB4F + 2 * seed * 0x165667B19E3779F9) % (1 << 64) | 1)
    out = h[: len(h) - n + 1] + U64(seed)
    for k in range(1, n):
        out = out * q + h[k : len(h) - n + 1 + k]
    return mix(out)


def same_row(row: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words from each position on lie in one row."""
    return row[: len(row) - n + 1] == row[n - 1 :] if len(row) >= n else np.zeros(0, bool)
