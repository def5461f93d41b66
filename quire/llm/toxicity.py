"""Toxicity: a linear-chain CRF tags toxic spans; marginals become document scores and offsets.

Tokens are runs of ASCII letters and digits and of all characters over U+007F, lower-cased (ASCII and U+00C0-00DE).
Their features are the word, its first 3 to 7 bytes and the neighbouring words, hashed.

The labels mark documents, not tokens.  Token labels of the training sample come from a lexicon: words and
word beginnings are taken greedily while they explain toxic documents that the lexicon does not explain
yet and hardly ever occur in clean ones.  The CRF is fitted to these token labels; a logistic model then
turns expected toxic tokens, the highest marginal and the length into a document score.

The sample is bounded: at most ``SAMPLE_DOCS`` labelled documents of each class, chosen by a hash of doc_id, of together at
most ``SAMPLE_DOCS * SAMPLE_CHARS`` characters.  Texts are whole, so long ones train too.  Scoring reads every whole text and nothing else of a document.

Cases: null or empty text: no tokens, the score of the base rate of texts without toxic tokens, no spans.
No labels, or labels of one class only: every score is that share of ones (0 without labels).  Null label rows are
ignored; doc_ids with several labels count as toxic if one of them is.  Repeated documents get equal scores.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .bytes_np import IS_START, Words, flat_text, mix64
from .store import slices, trim, with_fields, written

SAMPLE_DOCS = 1200
SAMPLE_CHARS = 6000
TABLE = 1 << 18
PREFIXES = (None, 3, 4, 5, 7)
#: A document is explained by so many toxic tokens.
HITS = 2

_SEPARATOR = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def tokens(column: pa.Array) -> Words:
    raw, offsets = flat_text(column)
    raw = raw.copy()
    if len(raw) > 1:
        upper = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        raw[1:][upper] += 0x20
    return Words(raw, offsets, _SEPARATOR)


def features(words: Words) -> np.ndarray:
    """``(n_features, n_tokens)`` cells of the weight table."""
    whole, n = words.prefix_hashes((None,))[0], len(words.start)
    out = np.empty((len(PREFIXES) + 2, n), dtype=np.int32)
    for k, size in enumerate(PREFIXES):  # one at a time: 64-bit hashes of all would be most of the memory
        h = whole if size is None else words.prefix_hashes((size,))[0]
        out[k] = mix64(h + np.uint64(k)) & np.uint64(TABLE - 1)
    first = words.first
    for k, shift in ((len(PREFIXES), 1), (len(PREFIXES) + 1, -1)):
        other = np.roll(whole, shift)
        edge = first[:-1] if shift == 1 else first[1:] - 1
        other[edge[np.diff(first) > 0]] = 0
        out[k] = mix64(other + np.uint64(1000 + k)) & np.uint64(TABLE - 1)
    return out


@dataclass
class Model:
    """Plain arrays of fixed size; it travels with the tasks."""

    weights: np.ndarray
    trans: np.ndarray
    head: np.ndarray
    constant: float | None = None

    def token_marginals(self, words: Words) -> np.ndarray:
        unary = np.zeros(len(words.start))
        for row in features(words):
            unary += self.weights[row]
        return crf.marginals(unary, words.first, self.trans)

    def scores(self, words: Words, p: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(words.offsets) - 1, self.constant)
        z = _summary(words, p) @ self.head
        return 1 / (1 + np.exp(-z))


def _summary(words: Words, p: np.ndarray) -> np.ndarray:
    """Per document: 1, capped expected toxic tokens, their log, the highest marginal, log length."""
    n = len(words.offsets) - 1
    expected = np.bincount(words.doc, weights=np.where(p > 0.05, p, 0), minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, words.doc, p)
    length = np.log1p(np.diff(words.first)) / 10
    return np.stack([np.ones(n), np.minimum(expected, 2), np.log1p(expected), top, length], axis=1)


def _lexicon(coded: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Greedy choice of features that explain toxic documents.

    ``coded[k, t]``: feature k of token t as one number, ``doc[t]``: its document.
    """
    n = len(toxic)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    places, counts = defaultdict(list), defaultdict(list)
    for row in coded:  # features of different rows have different numbers; row by row takes a fifth of the memory
        pairs, tokens_of = np.unique(row.astype(np.int64) * n + doc, return_counts=True)
        feature, where = pairs // n, pairs % n
        at = np.cumsum(np.diff(feature, prepend=feature[:1]) > 0)
        in_toxic = np.bincount(at, weights=toxic[where])
        in_clean = np.bincount(at) - in_toxic
        pure = (in_toxic >= 4) & (in_clean / n0 <= 0.02 * in_toxic / n1)
        keep = pure[at] & toxic[where]
        for f, d, c in zip(feature[keep].tolist(), where[keep].tolist(), tokens_of[keep].tolist()):
            places[f].append(d)
            counts[f].append(c)
    hits = np.zeros(n, dtype=np.int64)
    gain = {f: len(ds) for f, ds in places.items()}
    chosen = []
    while gain:
        f = max(gain, key=lambda x: (gain[x], x))
        left = int((hits[places[f]] < HITS).sum())
        if left < gain[f]:  # gains only fall, so a stale one is brought up to date and tried again
            gain[f] = left
            if left < 4:
                del gain[f]
            continue
        chosen.append(f)
        hits[places[f]] += counts[f]
        del gain[f]
    return np.array(chosen, dtype=np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) + 1e-2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """A model from sampled texts and labels; ``share`` is the share of toxic documents among all labelled ones."""
    toxic = toxic.astype(bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(np.zeros(1), np.zeros((2, 2)), np.zeros(5), float(share))
    words = tokens(pa.array(texts, pa.large_string()))
    cells = features(words)
    coded = cells[: len(PREFIXES)] + np.arange(len(PREFIXES), dtype=np.int32)[:, None] * TABLE
    chosen = _lexicon(coded, words.doc, toxic)
    labels = np.zeros(coded.shape[1], dtype=bool)
    for row in coded:
        labels |= np.isin(row, chosen)
    labels = labels.astype(np.int64)
    del coded, row
    weights, trans = crf.fit(cells, words.first, labels, TABLE)
    del cells, labels
    model = Model(weights.astype(np.float32), trans, np.zeros(5))
    p = model.token_marginals(words)
    share = min(max(share, 0.01), 0.99)
    balance = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    model.head = _logistic(_summary(words, p), toxic.astype(float), balance)
    return model


def held_out(column: str = "doc_id"):
    """True for the rows whose labels are never learned from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.crc32(F.col(column).cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {int(r.toxic): r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return Model(np.zeros(1), np.zeros((2, 2)), np.zeros(5), 0.0)
    # candidates are drawn from the ids first; twice the bound leaves room for texts that are missing
    drawn = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_docs)
        drawn = part if drawn is None else drawn.unionByName(part)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").where(F.length("text") > 0)
    found = written(joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))  # at most 4 * sample_docs rows
    sizes = found.select("doc_id", "toxic", F.length("text").alias("n")).collect()
    sizes.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    # a text longer than all the room a class has left is passed over
    ids, rows, room = [], {0: sample_docs, 1: sample_docs}, {0: sample_docs * sample_chars, 1: sample_docs * sample_chars}
    for r in sizes:
        if rows[r.toxic] and r.n <= room[r.toxic]:
            ids.append(r.doc_id)
            rows[r.toxic] -= 1
            room[r.toxic] -= r.n
    place = {i: k for k, i in enumerate(ids)}
    sample = sorted(found.where(F.col("doc_id").isin(ids)).collect(), key=lambda r: (r.toxic, place[r.doc_id])) if ids else []
    texts, toxic = [r.text for r in sample], np.array([r.toxic for r in sample])
    del sample, sizes
    model = fit(texts, toxic, counts.get(1, 0) / total)
    del texts
    trim()
    return model


SPANS = "array<struct<begin:int,end:int,p:float>>"


def tag(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """``docs`` with ``score`` (double) and, if wanted, ``spans``: offsets in code points of runs of tokens with p > 0.5."""
    docs = docs.drop("score", "spans")
    names = docs.columns
    schema = with_fields(docs.schema, "score double" + f", spans {SPANS}" * spans)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                words = tokens(part.column(at))
                p = m.token_marginals(words) if m.constant is None else np.zeros(len(words.start))
                out = [*part.columns, pa.array(m.scores(words, p))]
                if spans:
                    out.append(_spans(words, p))
                yield pa.RecordBatch.from_arrays(out, [*names, "score", *["spans"] * spans])
        trim()

    return docs.mapInArrow(run, schema)


def _spans(words: Words, p: np.ndarray) -> pa.Array:
    chars = np.concatenate([[0], np.cumsum(IS_START[words.raw])])
    base = chars[words.offsets[:-1]]
    hot = np.flatnonzero(p > 0.5)
    new = np.ones(len(hot), dtype=bool)
    new[1:] = (np.diff(hot) > 1) | (np.diff(words.doc[hot]) > 0)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(hot)]]) - 1
    a, b = hot[first], hot[last] if len(hot) else hot
    doc = words.doc[a]
    best = np.maximum.reduceat(p[hot], first) if len(hot) else np.zeros(0)
    body = pa.StructArray.from_arrays([pa.array((chars[words.start[a]] - base[doc]).astype(np.int32)), pa.array((chars[words.end[b]] - base[doc]).astype(np.int32)), pa.array(best.astype(np.float32))], ["begin", "end", "p"])
    ends = np.searchsorted(doc, np.arange(len(words.offsets))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), body)
