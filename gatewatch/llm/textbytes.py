"""Whole texts as numpy byte buffers, worked on in chunks that fit the CPU cache.

Every operator that reads text in Arrow batches goes through ``text_chunks``:
a chunk is a run of whole rows (never a part of a text) of about
``CHUNK_BYTES``; one longer text is a chunk of its own. Null is empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
U64 = np.uint64
#: odd multiplier of the rolling word hash, and its inverse modulo 2**64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def as_binary(column: pa.Array) -> pa.Array:
    """A string column as 64-bit-offset binary without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(lo, hi, buf, off)``: rows lo..hi-1, their bytes, and hi-lo+1 offsets into ``buf``;
    at most ``rows`` rows, for users that hold something wide per row."""
    col = as_binary(column)
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1), lo + (rows or n))
        yield lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of whole rows with about ``limit`` bytes of text (column ``at``), so
    that what a task holds does not hang on how long the texts of a batch happen to be."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class _Tables(dict):
    """Tables by base; a process makes its own, so none travels with a function."""

    def __reduce__(self):
        return _Tables, ()


_CACHE: dict[int, np.ndarray] = _Tables()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; long tables are not kept."""
    have = _CACHE.get(base)
    if have is None or len(have) < n:
        have = _powers(base, max(n, CHUNK_BYTES + 1))
        if len(have) <= 8 * CHUNK_BYTES:
            _CACHE[base] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift, multiply)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_table() -> np.ndarray:
    """Byte -> lower-cased word byte, or 0: digits, letters (A-Z lower-cased)
    and every byte of a non-ASCII character are word bytes, so on UTF-8 a run
    of them is a match of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing."""
    t = np.zeros(256, np.uint8)
    t[0x30:0x3A] = np.arange(0x30, 0x3A)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray, beginnings: tuple[int, ...] = ()) -> tuple:
    """Every word of a chunk: ``(start, end, row, hash)``; words never cross rows.
    With ``beginnings``, also for each of these lengths in bytes the pair
    (numbers of the longer words, hashes of their first bytes)."""
    low = table[buf]
    on = low > 0
    n = len(buf)
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = on[cut]
    last[cut - 1] = on[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum((low.astype(U64) + U64(1)) * powers(BASE, n), out=total[1:])
    back = powers(BASE_INV, n)
    h = (total[end] - total[start]) * back[start]
    row = np.searchsorted(off, start, "right") - 1
    if not beginnings:
        return start, end, row, mix64(h)
    parts = []
    for k in beginnings:
        at = np.flatnonzero(end - start > k)
        b = start[at]
        parts.append((at, mix64((total[b + k] - total[b]) * back[b] + U64(k))))
    return start, end, row, mix64(h), parts


def word_hash(word: bytes) -> int:
    """The hash that ``words`` gives one word (already lower-cased bytes)."""
    h = 0
    for i, b in enumerate(word):
        h = (h + (b + 1) * pow(BASE, i, 1 << 64)) & ((1 << 64) - 1)
    return int(mix64(np.array([h], U64))[0])
