"""SuperMinHash signatures (Ertl 2017), all elements of many sets at once.

Each element walks a random permutation of the ``m`` components (a partial Fisher-Yates shuffle);
at step j it offers the value j + r, 0 <= r < 1, to component p(j).  A set stops at the first j for which
every component already holds a value below j: no later step can change it.  Values are kept as
``(j << 32) | r`` in integers.
"""

from __future__ import annotations

import numpy as np

from .bytes_np import mix64

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = 0xA0761D6478BD642F


def signatures(elements: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """``(n_sets, m)`` uint64; set i holds ``elements[starts[i]:starts[i+1]]``, distinct uint64 hashes. Empty sets: all EMPTY."""
    n = len(starts) - 1
    sig = np.full(n * m, EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    elems, perm = elements, None
    for j in range(m):
        if not len(elems):
            break
        x = mix64(elems + np.uint64(j * _STEP & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        value = (x & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32)
        if j == 0:
            comp = k
        else:
            rows = np.arange(len(elems))
            comp = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = comp
        np.minimum.at(sig, owner * m + comp, value)
        # a set goes on while some component holds a value of a later step, or none
        worst = sig.reshape(n, m).max(axis=1)
        going = (worst >> np.uint64(32)) > np.uint64(j)
        keep = going[owner]
        if j == 0:
            elems, owner, k = elems[keep], owner[keep], k[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elems), 1))
            rows = np.arange(len(elems))
            perm[rows, k] = 0
            perm[:, 0] = k
        elif not keep.all():
            elems, owner, perm = elems[keep], owner[keep], perm[keep]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """``(n_sets, bands)`` int64 keys; equal keys mean equal rows of that band."""
    n, m = sig.shape
    rows = m // bands
    out = np.empty((n, bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(n, np.uint64(b + 1), dtype=np.uint64)
        for r in range(rows):
            h = mix64(h ^ sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)
