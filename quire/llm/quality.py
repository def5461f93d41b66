"""Quality rules, line first: lines that fail a rule are removed, then documents that lost too much text are rejected.

Line rules (on the raw UTF-8 bytes of each line that has a word):
* punctuation: no word ends in a sentence mark, or symbols ``#*$%&|<>`` are more than a tenth of the words,
  or three letters in five are capitals in a line of five words or more;
* navigation: separator words (``| > » • · -``) are a tenth of the words or more and at least two;
* boilerplate: the line holds one of ``BOILERPLATE`` (lower-cased A-Z).

``clean`` returns the text that is left: all other lines, also those without words, joined by U+000A.  A document is kept if it
passes the base rules (``n_words >= 50``, at most half of its words in 3-word windows that repeat, both on the whole text) and
the lines removed hold at most ``max_lost`` of its words.

Counts: words are runs of characters other than space and U+0009-000D; lines are split at U+000A.
Cases: null, empty or blank texts have no words, fail the base rules and are not kept; a null text stays null.  Repeated rows get
equal results; a null doc_id is kept as it is.  A text may lose all its lines and is then empty (and not kept).  Columns of
the input named like a result are replaced.  Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import IS_START, Words, flat_text, shingle_hashes
from .store import slices, with_fields

# Phrases of notices and page furniture in the languages of the corpus; only A-Z are lower-cased, so accents are as in lower case.
_PHRASES = {
    "en": ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here", "licensed under", "copyright (c)", "subscribe to"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "hier klicken", "newsletter abonnieren", "javascript aktivieren"),
    "es": ("todos los derechos reservados", "política de privacidad", "política de cookies", "aviso legal", "haga clic aquí", "condiciones de uso", "habilite javascript"),
    "fr": ("tous droits réservés", "politique de confidentialité", "mentions légales", "cliquez ici", "conditions d'utilisation", "activez javascript", "abonnez-vous à"),
}
BOILERPLATE = tuple(phrase.encode() for phrases in _PHRASES.values() for phrase in phrases)
MAX_LOST = 0.3
MIN_WORDS = 50

_NEWLINE = np.arange(256) == 10
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_LAST = np.isin(np.arange(256), np.frombuffer(b".!?:;\"')]", np.uint8))
#: Sentence marks outside ASCII by their last two or three bytes.
_WIDE = [int.from_bytes(c.encode(), "big") for c in "…”’»。！？"]
_DASHES = tuple(c.encode() for c in ("|", ">", "»", "•", "·", "-"))


def _sum(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    acc = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return acc[end] - acc[begin]


def measure(column: pa.Array, max_lost: float = MAX_LOST) -> tuple[dict[str, np.ndarray], pa.Array]:
    """All counts and verdicts of the texts of a column, and the texts without the lines that failed."""
    raw, offsets = flat_text(column)
    n_docs = len(offsets) - 1
    words, lines = Words(raw, offsets), Words(raw, offsets, _NEWLINE)
    n_words = np.diff(words.first)
    starts, space = IS_START[raw], np.ones(len(raw) + 1, dtype=np.int64)
    inside = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(inside, words.start, 1)
    np.subtract.at(inside, words.end, 1)
    inside = np.cumsum(inside)[:-1] > 0
    del space
    word_chars = _sum(starts & inside, offsets[:-1], offsets[1:])
    n_symbols = _sum(_SYMBOL[raw], offsets[:-1], offsets[1:])

    # repeated lines: equal to an earlier line of the text that has a word
    a, b = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
    line_words = b - a
    real = np.flatnonzero(line_words > 0)
    hashes, doc = lines.hashes(lower=False)[real], lines.doc[real]
    order = np.lexsort((hashes, doc))
    again = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    n_dup = np.bincount(doc[order][1:][again], minlength=n_docs)

    # words in 3-word windows that occur twice or more in the text
    win, at = shingle_hashes(words.hashes(lower=False), words.first, 3)
    win_doc = np.repeat(np.arange(n_docs), np.diff(at))
    wide = np.flatnonzero(n_words[win_doc] >= 3)
    order = wide[np.lexsort((win[wide], win_doc[wide]))]
    same = (win[order][1:] == win[order][:-1]) & (win_doc[order][1:] == win_doc[order][:-1])
    twice = np.zeros(len(win), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    place = words.first[:-1][win_doc] + (np.arange(len(win)) - at[:-1][win_doc])
    covered = np.zeros(len(words.start) + 2, dtype=bool)
    for k in range(3):
        covered[place[twice] + k] = True
    n_repeat = _sum(covered[: len(words.start)], words.first[:-1], words.first[1:])

    failed = _failed_lines(raw, words, lines.start[real], lines.end[real], a[real], b[real])
    lost = np.bincount(doc, weights=line_words[real] * failed, minlength=n_docs).astype(np.int64)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    text = _without(raw, offsets, lines.start[real][failed], lines.end[real][failed], column)
    counts = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & (lost <= max_lost * n_words + 1e-9),
        "n_lost_words": lost, "n_failed_lines": np.bincount(doc[failed], minlength=n_docs),
    }
    return counts, text


def _without(raw: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray, column: pa.Array) -> pa.Array:
    """The texts without the lines [begin, end): a line break stays if the line after it stays and an earlier line of its text does."""
    if not len(begin):
        return column.cast(pa.large_string())
    n = len(raw)
    goes, edge = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=np.int8)
    goes[begin] = True
    edge[begin], edge[end] = 1, -1  # no two lines touch: there is a break between them, or the end of a text
    edge[np.intersect1d(begin, end)] = 0
    keep = np.cumsum(edge[:n]) == 0
    breaks = np.flatnonzero(raw == 10)
    doc = np.searchsorted(offsets, breaks, side="right") - 1
    after = ~goes[breaks + 1] | (breaks + 1 == offsets[doc + 1])  # behind a last break there is an empty line
    # where the first line that stays begins
    heads = np.flatnonzero(goes[offsets[:-1]] & (np.diff(offsets) > 0))
    first = offsets[:-1].copy()
    first[heads] = n + 1
    np.minimum.at(first, doc[after], breaks[after] + 1)
    keep[breaks] = after & (breaks >= first[doc])
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    mask = column.is_null().to_numpy(zero_copy_only=False)
    valid = pa.py_buffer(np.packbits(~mask, bitorder="little")) if mask.any() else None
    return pa.Array.from_buffers(pa.large_string(), len(column), [valid, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[keep])])


def _failed_lines(raw: np.ndarray, words: Words, begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The line rules; ``a``, ``b``: first word of each line and the word after its last."""
    n = b - a
    stop = words.end - 1
    marked = _LAST[raw[stop]]
    wide = np.flatnonzero(raw[stop] >= 128)
    byte = [raw[np.maximum(stop[wide] - k, 0)].astype(np.int64) for k in range(3)]
    pair = byte[1] << 8 | byte[0]
    marked[wide] = np.isin(pair, _WIDE) | np.isin(byte[2] << 16 | pair, _WIDE)
    ended = _sum(marked, a, b) > 0
    symbols = _sum(_SYMBOL[raw], begin, end)
    letters = _sum(_LETTER[raw], begin, end)
    shouted = (n >= 5) & (5 * _sum(_UPPER[raw], begin, end) > 3 * letters)
    size = words.end - words.start
    short = np.flatnonzero(size <= 3)
    divider = np.zeros(len(size), dtype=bool)
    for i in short[~_LETTER[raw[words.start[short]]]]:
        divider[i] = raw[words.start[i] : words.end[i]].tobytes() in _DASHES
    dividers = _sum(divider, a, b)
    out = ~ended | (10 * symbols > n) | shouted | ((dividers >= 2) & (10 * dividers >= n))
    text = raw.tobytes().lower()
    for phrase in BOILERPLATE:
        at = text.find(phrase)
        while at >= 0:
            i = int(np.searchsorted(begin, at, side="right")) - 1
            if i >= 0 and at + len(phrase) <= end[i]:
                out[i] = True
            at = text.find(phrase, at + 1)
    return out


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, n_failed_lines long"


def clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with ``text`` without the lines that failed, and the counts and verdicts (of the whole text); see the module's text."""
    names = [f.split()[0] for f in _RESULT.split(", ")]
    docs = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    kept = docs.columns
    schema = with_fields(docs.schema, _RESULT)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            kind = batch.schema.field(at).type
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                found, text = measure(part.column(at), max_lost)
                columns = list(part.columns)
                columns[at] = text.cast(kind)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[n] if found[n].dtype == bool else found[n].astype(np.int64)) for n in names)], [*kept, *names])

    return docs.mapInArrow(run, schema)
