"""Ids of the ``tokenizers`` library for vocabularies that drop white space, one call per distinct word.

Such a tokenizer never joins characters across ASCII white space, so the ids of a text are those of its words.
Plain words are encoded many to a call: each of their parts ends in an id that carries the end-of-word mark,
which tells the words apart again; if the count is not as expected, the words are encoded one by one.

Cases: null and empty texts have no ids but the end id that is asked for; texts of white space likewise; characters outside the
vocabulary become the ids the library gives them; very long words and texts are encoded whole; no texts give no ids.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from .unit_cache import UnitCache

_JOIN = 4096
_RUNS = re.compile("[A-Za-z]+|[^A-Za-z]+")
_OTHER = re.compile("[0-9']|<[|]")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PLAIN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def _words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts and their number in each.

    So that fewer words differ, A-Z is lower-cased and a stop or comma between an ASCII letter or digit and white
    space stands apart, as it is a part of its own for the tokenizer.
    """
    coded = [t.encode() if t else b"" for t in texts]
    raw = b"\n".join(coded) + b"\n"
    if b"<|" not in raw:  # the strings of special tokens are told by case
        raw = raw.lower()
    flat = np.frombuffer(raw, dtype=np.uint8)
    stop = np.flatnonzero((flat[1:-1] == 44) | (flat[1:-1] == 46)) + 1
    stop = stop[_PLAIN[flat[stop - 1]] & _SPACE[flat[stop + 1]]]
    ends = np.cumsum([len(c) + 1 for c in coded])
    ends = ends + np.searchsorted(stop, ends)
    flat = np.insert(flat, stop, 32)
    blank = _SPACE[flat]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    return flat.tobytes().split(), np.diff(np.searchsorted(first, ends), prepend=0)


class WordTokenizer:
    def __init__(self, path: str, plain_specials: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = json.dumps(spec.get("pre_tokenizer") or {})
        if spec["model"].get("end_of_word_suffix") != "</w>" or '"behavior": "Removed", "invert": true' not in pre:
            raise ValueError("this vocabulary does not split texts at white space")
        self.n_ids = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.n_ids, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache = UnitCache(self._encode_units, limit=500_000)

    @property
    def dtype(self) -> str:
        """Little-endian unsigned type that holds every id."""
        return "<u2" if self.n_ids <= 1 << 16 else "<u4"

    def _one_by_one(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        lens = np.array([len(x) for x in out], dtype=np.int64)
        return np.fromiter((i for x in out for i in x), dtype=np.int32, count=int(lens.sum())), lens

    def _joined(self, units: list[str], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, dtype=np.int32)
        at = np.flatnonzero(self.ends[ids])
        if len(at) != parts.sum():
            return self._one_by_one(units)
        return ids, np.diff(at[np.cumsum(parts) - 1], prepend=-1)

    def _encode_units(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        units = [u.decode() for u in new]
        parts = np.zeros(len(units), dtype=np.int64)
        for i, u in enumerate(units):
            # letters below U+0100 stay single letters when lower-cased; runs of ASCII letters and of marks are parts
            if u.isalpha():
                parts[i] = max(u) < "Ā"
            elif u.isascii() and not _OTHER.search(u):
                parts[i] = len(_RUNS.findall(u))
        lens = np.zeros(len(units), dtype=np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        plain, rest = np.flatnonzero(parts), np.flatnonzero(parts == 0)
        blocks = [plain[i : i + _JOIN] for i in range(0, len(plain), _JOIN)]
        for at in blocks:
            pieces.append(self._joined([units[i] for i in at], parts[at]))
        if len(rest):
            blocks.append(rest)
            pieces.append(self._one_by_one([units[i] for i in rest]))
        for at, (_, n) in zip(blocks, pieces):
            lens[at] = n
        starts = np.cumsum(lens) - lens
        flat = np.zeros(int(lens.sum()), dtype=np.int32)
        for at, (ids, n) in zip(blocks, pieces):
            first = np.cumsum(n) - n
            flat[np.repeat(starts[at] - first, n) + np.arange(len(ids))] = ids
        return flat, lens

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each; with ``end_id`` after each text. Null: empty."""
        flat, counts = self.cache.ids(*_words(texts))
        if end_id is not None:
            flat = np.insert(flat, np.cumsum(counts), end_id)
            counts = counts + 1
        return flat, counts


@lru_cache(maxsize=2)
def tokenizer(path: str, plain_specials: bool = False) -> WordTokenizer:
    """One tokenizer per Python worker."""
    return WordTokenizer(path, plain_specials)
