"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a batch lie in one flat symbol array.  In every round the rank of each neighbouring pair is
looked up, each word takes its lowest rank (segmented minimum), all leftmost non-overlapping pairs of that rank
merge at once, and the array is compacted; words without a pair left over leave the array.

A merge at once equals one merge after another unless the new piece can at once take part in a better ranked
pair.  Pieces for which the vocabulary has such a pair are marked, and for them only the leftmost pair of
a word merges in a round.

Words start where a space follows another character, and line breaks stand alone: the model's pieces
have spaces at their start only, none with a line break, and no two merges of equal score but runs of spaces, which is checked when a model is loaded.
For runs of spaces of equal score the tests compare all lengths with the library.

Cases: a null text counts as empty; an empty text has the end id only and decodes to an empty text; characters
without a piece become byte pieces; U+2581 encodes as a space does; very long texts and very long words work (a word
of n equal characters takes about log n rounds).  Null doc_id, repeated rows and other columns are kept as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import slices, trim, with_fields
from .unit_cache import UnitCache

SPACE = "▁"
_UNITS = re.compile(rb"\n| *[^ \n]+| +")
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(blob: bytes):
    """(field number, value) of a protocol-buffer message; length-delimited values as bytes, others as int or raw."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = blob[i]
            out |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return out, i

    i = 0
    while i < len(blob):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = blob[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = blob[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """Pieces and pair ranks of a SentencePiece BPE model file."""

    def __init__(self, path: str) -> None:
        pieces, scores, kinds, norm = [], [], [], {}
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    piece = dict(_fields(value))
                    pieces.append(piece[1].decode())
                    scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                    kinds.append(piece.get(3, _NORMAL))
                elif field == 3:
                    norm = dict(_fields(value))
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only models with the identity normalizer, a dummy prefix and normal pieces are supported")
        normal = [i for i, k in enumerate(kinds) if k == _NORMAL]
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", pieces[i]) for i in normal):
            raise ValueError("the model has pieces that cross a word boundary")
        joined = [scores[i] for i in normal if len(pieces[i]) > 1 and pieces[i].strip(SPACE)]
        if len(set(joined)) < len(joined):
            raise ValueError("the model has pieces of equal score, whose merges the library orders by their place")
        self.n_ids = len(pieces)
        self.end_id = kinds.index(_CONTROL, pieces.index("</s>"))
        self.byte_ids = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        by_text = {pieces[i]: i for i in normal}
        rank_of = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-scores[i], i)))}
        # symbols: ids of normal pieces, then single characters of pieces that are no piece themselves
        symbols, extra = dict(by_text), self.n_ids
        for i in normal:
            for c in pieces[i]:
                if c not in symbols:
                    symbols[c], extra = extra, extra + 1
        keys, ranks, merged = [], [], []
        guarded = np.zeros(extra, dtype=bool)
        for text, i in by_text.items():
            for k in range(1, len(text)):
                left, right = symbols.get(text[:k]), symbols.get(text[k:])
                if left is not None and right is not None:
                    keys.append(left * extra + right)
                    ranks.append(rank_of[i])
                    merged.append(i)
                for part in (left, right):
                    if part is not None and part in rank_of and rank_of[part] > rank_of[i]:
                        guarded[part] = True
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.merged = np.array(merged, dtype=np.int64)[order]
        self.guarded, self.base = guarded, extra
        self.chars = {c: s for c, s in symbols.items() if len(c) == 1}
        blank = {_CONTROL: b"", _UNKNOWN: " ⁇ ".encode()}
        self.text = [bytes([int(p[3:5], 16)]) if k == _BYTE else blank[k] if k in blank else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds)]
        self.is_byte = [k == _BYTE for k in kinds]
        self.is_control = [k == _CONTROL for k in kinds]
        digits = [f"{i} ".encode() for i in range(self.n_ids)]
        width = max(map(len, digits))
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), dtype=np.uint8).reshape(-1, width)
        self.cache = UnitCache(self._encode_units)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], np.iinfo(np.int64).max), self.merged[at]

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that begin with U+2581 instead of a space."""
        texts = [u.decode().replace(" ", SPACE) for u in units]
        chars, get = "".join(texts), self.chars.get
        sym = np.fromiter((get(c, -1 - ord(c)) for c in chars), dtype=np.int64, count=len(chars))
        word = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        done_sym, done_word = [], []
        none = np.iinfo(np.int64).max
        rank, into = np.full(len(sym), none), np.zeros(len(sym), dtype=np.int64)
        if len(sym) > 1:
            same = word[1:] == word[:-1]
            rank[:-1], into[:-1] = self._pairs(sym[:-1], sym[1:])
            rank[:-1][~same] = none
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lens = np.diff(np.concatenate([starts, [len(word)]]))
            low = np.repeat(np.minimum.reduceat(rank, starts), lens)
            over = low == none
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, into, low = sym[keep], word[keep], rank[keep], into[keep], low[keep]
                if not len(sym):
                    break
            pick = rank == low
            at = np.flatnonzero(pick)
            # leftmost first within a run of overlapping pairs: every other one
            run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])])
            head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            good = (np.arange(len(at)) - head) % 2 == 0
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            good &= first | ~self.guarded[into[at]]
            # a guarded pair after another pair of the word waits for a later round
            at = at[good]
            sym[at] = into[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), dtype=bool)
            touched[at] = True
            before = at[at > 0] - 1
            before = np.where(keep[before], before, before - 1)
            touched[before[before >= 0]] = True
            sym, word, rank, into, touched = sym[keep], word[keep], rank[keep], into[keep], touched[keep]
            new = np.flatnonzero(touched)
            last = new == len(sym) - 1
            rank[new[last]] = none
            new = new[~last]
            r, m = self._pairs(sym[new], sym[new + 1])
            r[word[new] != word[new + 1]] = none
            rank[new], into[new] = r, m
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        return self._to_ids(sym, word, len(units))

    def _to_ids(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        plain = (sym >= 0) & (sym < self.n_ids)
        if plain.all():
            return sym.astype(np.int32), np.bincount(word, minlength=n)
        by_id = {s: c for c, s in self.chars.items() if s >= self.n_ids}
        rare = np.flatnonzero(~plain)
        coded = [(by_id[int(s)] if s >= 0 else chr(-1 - int(s))).encode() for s in sym[rare]]
        size = np.ones(len(sym), dtype=np.int64)
        size[rare] = [len(c) for c in coded]
        out = np.repeat(sym, size)
        at = np.repeat(~plain, size)
        out[at] = self.byte_ids[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        return out.astype(np.int32), np.bincount(word, weights=size, minlength=n).astype(np.int64)

    def encode(self, texts: list[str | None], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each, with the end id after each text."""
        units = [_UNITS.findall(b" " + t.replace(SPACE, " ").encode()) if t else [] for t in texts]
        flat, counts = self.cache.ids([u for t in units for u in t], np.fromiter(map(len, units), dtype=np.int64, count=len(units)))
        if end:
            flat = np.insert(flat, np.cumsum(counts), self.end_id)
            counts = counts + 1
        return flat, counts

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, one leading space taken away, bytes that are no UTF-8 as U+FFFD."""
        text = self.text
        out = b"".join([text[i] for i in ids])
        lead = next((i for i in ids if not self.is_control[i]), None)
        if lead is not None and not self.is_byte[lead] and text[lead].startswith(b" ") and lead != 0:
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        out, run, first = [], bytearray(), True

        def flush() -> None:
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[i : i + n].decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i in ids:
            if self.is_byte[i]:
                run += self.text[i]
                first = False
                continue
            if self.is_control[i]:
                continue
            flush()
            piece = self.text[i].decode()
            out.append(piece[1:] if first and i and piece.startswith(" ") else piece)
            first = False
        flush()
        return "".join(out)

    def decimal(self, flat: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Decimal ids, a space after each, and the byte position where each id ends."""
        cells = self.digits[flat]
        used = cells != 0
        return cells[used].tobytes(), np.cumsum(used.sum(axis=1))


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model per Python worker."""
    return PieceModel(path)


def _texts(batches):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for lo, hi in slices(batch.column(at)):
            part = batch.slice(lo, hi - lo)
            yield part, part.column(at).to_pylist()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int, end id last) of ``text``; a column ``ids`` it had is replaced."""
    docs = docs.drop("ids")
    names = docs.columns
    schema = with_fields(docs.schema, "ids array<int>")

    def run(batches):
        for part, texts in _texts(batches):
            flat, counts = model(path).encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*names, "ids"])
        model(path).cache.clear()
        trim()

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column ``decoded`` of ``ids``; null ids give an empty text."""
    encoded = encoded.drop("decoded")
    names, schema = encoded.columns, with_fields(encoded.schema, "decoded string")

    def run(batches):
        for batch in batches:
            texts = [model(path).decode(x or []) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids if wanted, columns to keep) of each text, encoded and decoded again in one pass."""
    import hashlib

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        for part, texts in _texts(batches):
            m = model(path)
            flat, counts = m.encode(texts)
            ends = np.cumsum(counts)
            decimal, at = m.decimal(flat)
            listed, shas, back, lo, b0 = flat.tolist(), [], [], 0, 0
            for hi in ends:
                b1 = int(at[hi - 1])
                shas.append(hashlib.sha256(decimal[b0 : b1 - 1]).hexdigest())
                back.append(hashlib.sha256(m.decode(listed[lo:hi]).encode()).hexdigest())
                lo, b0 = int(hi), b1
            doc_id = part.column(part.schema.get_field_index("doc_id"))
            out = {"doc_id": doc_id, "n_tokens": pa.array(counts), "ids_sha256": pa.array(shas), "decoded_sha256": pa.array(back)}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            out |= {c: part.column(part.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
        model(path).cache.clear()
        trim()

    schema = T.StructType.fromDDL("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return docs.mapInArrow(run, T.StructType([*schema.fields, *fields]))
