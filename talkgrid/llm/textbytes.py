"""Vectorised tokenising and hashing of Arrow text columns, used inside Spark tasks.

Texts stay UTF-8 bytes: every separator class used here is ASCII, so a byte table decides
word membership exactly, and numpy handles millions of words without per-row Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer document is still handled whole.
PIECE_BYTES = 1 << 20

SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE2 = np.uint64(pow(int(_BASE2), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2^64; kept up to a piece's size."""
    key = int(second)
    if key not in _powers or len(_powers[key][0]) <= n:
        base, inverse = (_BASE2, _INVERSE2) if second else (_BASE, _INVERSE)
        size = max(n, PIECE_BYTES if not second else PIECE_BYTES // 4) + 1
        made = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if n > 4 * PIECE_BYTES:
            return made[0], made[1]
        _powers[key] = (made[0], made[1])
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values, so that low bits are usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end] for each span."""
    p, q = powers(len(values), second)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * p[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed eight at a time; the rest of a longer one goes by polynomial.
EIGHTS = 64


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each word, read eight bytes at a time."""
    a, b = (_BASE2, _INVERSE2) if second else (_BASE, _INVERSE)
    n = ends - starts
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), np.uint64, padded, strides=(1,))
    h = mix(((n.astype(np.uint64) * a) ^ (eight[starts] & _MASKS[np.minimum(n, 8)])) * b + a)
    at, k = np.flatnonzero(n > 8), 8
    while len(at) and k < EIGHTS:
        h[at] = mix((h[at] ^ (eight[starts[at] + k] & _MASKS[np.minimum(n[at] - k, 8)])) * b + a)
        k += 8
        at = at[n[at] > k]
    if len(at):
        size = n[at] - EIGHTS
        first = np.cumsum(size) - size
        rest = buf[np.repeat(starts[at] + EIGHTS - first, size) + np.arange(int(size.sum()))]
        h[at] = mix(h[at] ^ span_hashes(rest, first, first + size, second))
    return h


class Words:
    """The words of some documents: buf holds their bytes, starts and ends each word's place in it,
    doc its document's row, first the row's first word (one more entry than rows)."""

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        bufs, n = column.buffers(), len(column)
        off = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
        self.raw = raw[off[0] : off[-1]]
        self.off = off - off[0]
        data = self.raw.tobytes()  # bytes.translate is faster than indexing a table by bytes
        self.buf = np.frombuffer(data.translate(LOWER.tobytes()), np.uint8) if lower else self.raw
        inside = np.zeros(len(self.buf) + 2, bool)
        inside[1:-1] = np.frombuffer((self.buf.tobytes() if lower else data).translate(table.tobytes()), bool)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2].copy(), edges[1::2].copy()
        seams = np.unique(self.off[(self.off > 0) & (self.off < len(self.buf))])
        seams = seams[inside[seams] & inside[seams + 1]]
        if len(seams):  # the last word of a text and the first of the next
            self.starts = np.sort(np.concatenate([self.starts, seams]))
            self.ends = np.sort(np.concatenate([self.ends, seams]))
        self.first = np.searchsorted(self.starts, self.off)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def hashes(self, second: bool = False) -> np.ndarray:
        return word_hashes(self.buf, self.starts, self.ends, second)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about limit bytes of text; a longer document is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        a = 0
        while a < len(sizes):
            base = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(a, b - a)
            a = b


def window_hashes(word_hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word numbers) and hashes of all k-word windows that stay in one document."""
    n = len(word_hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    good = np.zeros(n, bool)
    for_end = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    good = at + k <= for_end
    starts = at[good]
    return starts, span_hashes(word_hashes, starts, starts + k, second=True)
