"""Token ids of texts by way of their distinct units.

A tokenizer that never joins characters across certain boundaries gives the same ids for a text as for its
units one after another.  Each distinct unit is encoded once and texts are put together from a flat table by
one numpy gather.  The table is emptied when it holds ``limit`` units, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class _Codes(dict):
    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, unit: bytes) -> int:
        code = self[unit] = len(self)
        self.new.append(unit)
        return code


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[starts[i]:starts[i] + lens[i]]``."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    step = np.ones(total, dtype=np.int64)
    some = lens > 0
    s, n, e = starts[some], lens[some], ends[some]
    if total:
        step[0] = s[0]
        step[e[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return flat[np.add.accumulate(step, out=step)]


class UnitCache:
    """``encode(units) -> (flat ids, lengths)`` is called once per distinct unit while it stays in the table."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000) -> None:
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        """Forget all units; a task does so at its end, since idle workers keep what they hold."""
        self.codes = _Codes()
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.starts, self.lens = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _grow(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if len(old) < need:
            new = np.zeros(max(need, 2 * len(old)), dtype=old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def ids(self, units: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts, given as the units of all texts and the units of each, and the number of ids of each text."""
        if len(self.codes) > self.limit:
            self.clear()
        codes = np.fromiter(map(self.codes.__getitem__, units), dtype=np.int64, count=len(units))
        if new := self.codes.new:
            flat, lens = self.encode(new)
            n, first = len(self.codes), len(self.codes) - len(new)
            self._grow("flat", self.used + len(flat))
            self._grow("starts", n)
            self._grow("lens", n)
            self.flat[self.used : self.used + len(flat)] = flat
            self.lens[first:n] = lens
            self.starts[first:n] = self.used + np.cumsum(lens) - lens
            self.used += len(flat)
            self.codes.new = []
        lens = self.lens[codes]
        acc = np.concatenate([[0], np.cumsum(lens)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return gather(self.flat, self.starts[codes], lens), acc[at[1:]] - acc[at[:-1]]
