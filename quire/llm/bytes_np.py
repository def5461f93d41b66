"""Vectorised byte-level text helpers on Arrow string buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` runs; hashing lower-cases A-Z only.  All functions
work on the flat UTF-8 buffer of a batch, so no Python string is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
#: Odd base of the polynomial word hash, and its inverse modulo 2**64.
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64 arrays (wrapping arithmetic)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_table(lower: bool) -> np.ndarray:
    t = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        t[65:91] = t[97:123]
    return t


_TABLES = {True: _byte_table(True), False: _byte_table(False)}
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: First byte of a UTF-8 code point (not 10xxxxxx).
IS_START = (np.arange(256) & 0xC0) != 0x80


def flat_text(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null texts have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_KEPT_POWERS = 1 << 20
_kept: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)``, modulo 2**64; not to be written to."""
    have = _kept.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    out = np.full(n if n > _KEPT_POWERS else 1 << max(16, (n - 1).bit_length()), np.uint64(base), dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if len(out) <= _KEPT_POWERS:
        _kept[base] = out
    return out[:n]


class Words:
    """Word spans of a flat buffer: ``start``/``end`` byte positions, ``doc`` row of each, ``first`` word of each row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _IS_SPACE) -> None:
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = ~separators[raw]
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[: n - 1] if n else inside[:0]
        edges = offsets[:-1][np.diff(offsets) > 0]
        begins[edges] = inside[edges]
        ends = inside[:-1] & ~inside[1:]
        if n:
            last = offsets[1:][np.diff(offsets) > 0] - 1
            ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64-bit hash of each word from prefix sums of a byte polynomial."""
        return self.prefix_hashes((None,), lower)[0]

    def prefix_hashes(self, sizes: tuple[int | None, ...], lower: bool = True) -> np.ndarray:
        """``(len(sizes), n_words)`` hashes of the first so many bytes of each word; None: of the whole word."""
        raw, out = self.raw, np.empty((len(sizes), len(self.start)), dtype=np.uint64)
        if not out.size:
            return out
        step = 1 << 18  # the polynomial runs over pieces of the buffer, so its tables stay small
        table, lo = _TABLES[lower], 0
        longest = int((self.end - self.start).max())
        span = step + longest
        up, down = _powers(span + 1, _BASE), _powers(span + 1, _BASE_INV)
        while lo < len(self.start):
            base = self.start[lo]
            hi = int(np.searchsorted(self.start, base + step))
            hi = max(hi, lo + 1)
            stop = self.end[hi - 1]
            part = table[raw[base:stop]] * up[: stop - base]
            acc = np.zeros(stop - base + 1, dtype=np.uint64)
            np.add.accumulate(part, out=acc[1:])
            s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
            for k, size in enumerate(sizes):
                to = e if size is None else np.minimum(e, s + size)
                out[k, lo:hi] = (acc[to] - acc[s]) * down[s] + (to - s).astype(np.uint64) * _GOLD
            lo = hi
        return mix64(out)


#: Odd multipliers of the word positions inside a shingle.
_SLOTS = mix64(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows, row by row, and the first window of each row.

    A row with 1 to ``width - 1`` words gives its whole sequence as one window; a row without words gives none.
    """
    counts = np.diff(first)
    n_win = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    starts = np.concatenate([[0], np.cumsum(n_win)])
    total = len(words)
    if total >= width:
        acc = words[: total - width + 1] * _SLOTS[0]
        for k in range(1, width):
            acc += words[k : total - width + 1 + k] * _SLOTS[k]
    else:
        acc = np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.arange(len(counts)), n_win)
    at = first[:-1][row] + (np.arange(len(row)) - starts[:-1][row])
    out = np.empty(len(row), dtype=np.uint64)
    full = counts[row] >= width
    out[full] = mix64(acc[at[full]])
    short = np.flatnonzero(~full)
    acc = counts[row[short]].astype(np.uint64) * _SLOTS[31]
    for k in range(width - 1):
        has = counts[row[short]] > k
        acc[has] += words[at[short[has]] + k] * _SLOTS[k + 32]
    out[short] = mix64(acc)
    return out, starts
