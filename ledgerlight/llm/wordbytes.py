"""Words of many texts at once, as spans and 64-bit hashes over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
# Bytes of the words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by need."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        _POWERS[base] = have
    return have[:n]


def parts(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 21, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows: about ``most`` bytes, at most ``rows`` rows."""
    column = batch.column(name).cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), a + rows, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes in ``table``; no run crosses a row."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = table[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    start = np.flatnonzero(starts)
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside[:-1] & (~inside[1:] | first[1:])
    end = np.flatnonzero(ends)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span."""
    if not len(start):
        return np.zeros(0, U64)
    # Sums of byte * base**position: a span's hash is the difference of two sums, moved back to position 0.
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, len(data)), out=sums[1:])
    back = powers(pow(_BASE, -1, 1 << 64), len(data))
    return mix64((sums[end] - sums[start]) * back[start] + (end - start).astype(U64))


def shingles(word_hash: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every ``width`` consecutive words of a row; a shorter row is one shingle, an empty one none."""
    counts = np.bincount(row, minlength=n_rows)
    starts = np.cumsum(counts) - counts
    h = np.zeros(max(len(word_hash) - width + 1, 0), U64)
    for k in range(width):
        h = h * U64(0xD6E8FEB86659FD93) + word_hash[k : k + len(h)]
    keep = np.zeros(len(h), bool)
    if len(h):
        keep[:] = row[: len(h)] == row[width - 1 :]
    short = np.flatnonzero((counts > 0) & (counts < width))
    extra = np.empty(len(short), U64)
    for i, r in enumerate(short.tolist()):
        value = int(counts[r])
        for x in word_hash[starts[r] : starts[r] + counts[r]].tolist():
            value = (value * 0xA0761D6478BD642F + x) & (1 << 64) - 1
        extra[i] = value
    return mix64(np.concatenate([h[keep], extra])), np.concatenate([row[: len(h)][keep], short])
