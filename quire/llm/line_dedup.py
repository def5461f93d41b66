"""Line dedup by a deletion-neighbourhood join.

A line's words (A-Z lower-cased) are its symbols.  Lines of ``min_words`` words or more are duplicates of an earlier line with the
same words, or of one near it: two lines are near if an edit distance (words inserted, deleted or replaced) of
min(``bound``, n // ``per_words``) or less lies between them, n the words of the shorter one.  So with the default values a line of
8 words or more may differ in one word, and with ``bound`` 2 a line of 16 words or more in two; fewer words must be equal.
Earlier means smaller (doc_id, hash of the text, line number), null doc_ids last.  A line goes if any earlier line is
that close, so the earliest of each stays.  Shorter lines stay, unless ``short_runs`` is set: then a line of 1 to ``min_words`` - 1
words goes as part of a copied run.  That is: the nearest lines of ``min_words`` or more before and after it in its text
(those there are) all go, and an earlier line has the same words at the same distance from an equal line of
``min_words`` or more on the same side.

Plan
1. One Arrow pass hashes every line (128 bits) with its beginning and end; equal lines become one class.
2. Two lines within one edit share their first or their last half.  Classes that share neither with another class
   are out, which loses nothing.  For two edits there is no such test.
3. The others emit the line itself and all variants with up to ``bound`` words deleted, as hashed keys with the deleted
   positions.  Lines that share a variant and the position differ in that word only; a line equal to another's variant
   differs by one word more or less; for two edits see ``_two_edits``.  So the minimum of each key and of each (key, position)
   gives every line its earliest neighbour: groups are never expanded into pairs, and the minima combine before the shuffle.
4. The edit distance of each line and its neighbour is verified on their words.
A line of n words has n variants with one word deleted and n * n / 2 with two.  They are made in bounded slices, but ``bound`` 2 is
for tables whose lines are not long: it takes the square of their length in time.

Cases: null text: no lines, stays null.  Empty lines stay, and so do blank ones.  Empty table: no rows.  Rows that share a doc_id, or
have none, are documents of their own if their texts differ (by a 64-bit hash); rows equal in doc_id and text are one document, so
equal lines at equal places get the same verdict.  A text whose lines all went is empty; ``drop_lines`` marks it.  Other
columns are kept under their names; n_chars is set anew where it exists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import Words, _powers, flat_text, mix64
from .pair_join import with_values
from .store import slices, trim, with_fields, written

_B1, _B2 = 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47
_INVERSE = {b: pow(b, -1, 1 << 64) for b in (_B1, _B2)}


class Lines:
    """Lines of the texts of a string column: ``doc``, ``no``, ``n`` words, ``first`` word of each (and the end), word hashes."""

    def __init__(self, column: pa.Array) -> None:
        raw, offsets = flat_text(column)
        breaks = np.flatnonzero(raw == 10)
        has = ~np.asarray(column.is_null())
        heads = offsets[:-1][has]
        self.begin = np.sort(np.concatenate([heads, breaks + 1]), kind="stable")
        # the line after a break belongs to the text of the break; the first line of a text is at its head
        owner = np.concatenate([np.flatnonzero(has), np.searchsorted(offsets, breaks, side="right") - 1])
        self.doc = np.sort(owner, kind="stable")
        counts = np.bincount(self.doc, minlength=len(column))
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.no = np.arange(len(self.doc)) - self.starts[self.doc]
        order = np.lexsort((np.concatenate([heads, breaks + 1]), owner))
        self.begin = np.concatenate([heads, breaks + 1])[order]
        last = np.zeros(len(self.doc), dtype=bool)
        if len(last):
            last[self.starts[1:][counts > 0] - 1] = True
        self.end = np.where(last, offsets[1:][self.doc] if len(self.doc) else 0, np.roll(self.begin, -1) - 1)
        self.raw = raw
        words = Words(raw, offsets)
        self.words = words.hashes()
        line_of = np.searchsorted(self.begin, words.start, side="right") - 1
        self.n = np.bincount(line_of, minlength=len(self.doc)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def sums(self, base: int) -> np.ndarray:
        """Prefix sums of ``word * base**i`` over all words."""
        acc = np.zeros(len(self.words) + 1, dtype=np.uint64)
        np.add.accumulate(self.words * _powers(len(self.words), base), out=acc[1:])
        return acc

    def spans(self, a: np.ndarray, b: np.ndarray, base: int, acc: np.ndarray, down: np.ndarray) -> np.ndarray:
        """Hashes of the words a..b-1."""
        return mix64((acc[b] - acc[a]) * down[a] + (b - a).astype(np.uint64))


def _short_lines(x: Lines, h1: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of 1 to ``min_words`` - 1 words, and in two rows their neighbours (the nearest longer lines of the text before and after, or -1) and keys.

    A key stands for the words of the line, those of the neighbour, their distance and the side.
    """
    short, long = np.flatnonzero((x.n > 0) & (x.n < min_words)), np.flatnonzero(x.n >= min_words)
    at = np.searchsorted(long, short)
    beside, keys = np.full((2, len(short)), -1), np.zeros((2, len(short)), dtype=np.int64)
    h = h1.view(np.uint64)
    for side, where in enumerate((at - 1, at)):
        some = np.flatnonzero((where >= 0) & (where < len(long)))
        other = long[where[some]]
        same = x.doc[other] == x.doc[short[some]]
        some, other = some[same], other[same]
        beside[side, some] = other
        gap = (np.abs(other - short[some]) * 2 + side).astype(np.uint64)
        keys[side, some] = mix64(mix64(h[short[some]] + gap * np.uint64(_B2)) + h[other] * np.uint64(_B1)).view(np.int64)
    return short, beside, keys


def _half(n: np.ndarray) -> np.ndarray:
    """Length of the ends that a line of n words compares: a power of two, at most (n - 1) / 2."""
    return 1 << np.maximum(np.log2(np.maximum((n - 1) // 2, 1)).astype(np.int64), 0)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t): ``t`` tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("t", F.xxhash64("text"))


def _scan(docs: DataFrame, min_words: int, per_words: int, short_runs: bool = False) -> DataFrame:
    """(doc_id, t, no, n, h1, h2, ends): lines of ``min_words`` words or more; ``n``: words, ``ends``: keys of beginnings and ends, none for short lines.

    With ``short_runs`` also shorter lines, by a column ``keys`` that is null for the others: see ``_short_lines``.
    """

    names = ["doc_id", "t", "no", "n", "h1", "h2", "ends", *["keys"] * short_runs]

    def run(batches):
        for batch in batches:
            ids, text, t = (_column(batch, c) for c in ("doc_id", "text", "t"))
            for lo, hi in slices(text):
                x = Lines(text.slice(lo, hi - lo))
                keep = np.flatnonzero(x.n >= min_words)
                a, b, n = x.first[:-1][keep], x.first[1:][keep], x.n[keep]
                h = []
                for base in (_B1, _B2):
                    acc, down = x.sums(base), _powers(len(x.words) + 1, _INVERSE[base])
                    h.append(x.spans(a, b, base, acc, down).view(np.int64))
                    if base == _B1:
                        near = n >= per_words
                        own, other = _half(n), _half(n - 1)
                        keys = []
                        for k, (size, use) in enumerate(((own, near), (other, near & (other != own) & (n > per_words)))):
                            del k
                            head = x.spans(a, np.where(use, a + size, a), base, acc, down)
                            tail = x.spans(np.where(use, b - size, b), b, base, acc, down)
                            keys += [(head & ~np.uint64(1), use), (tail | np.uint64(1), use)]
                flat = np.stack([k for k, _ in keys], axis=1).view(np.int64)
                used = np.stack([u for _, u in keys], axis=1)
                offs = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
                ends = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat[used]))
                fields = lambda rows: [c.slice(lo, hi - lo).take(pa.array(x.doc[rows])) for c in (ids, t)] + [pa.array(v[rows].astype(np.int32)) for v in (x.no, x.n)]  # noqa: E731, B023
                columns = [*fields(keep), pa.array(h[0]), pa.array(h[1]), ends]
                yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(keep), pa.list_(pa.int64()))] * short_runs, names)
                if short_runs:
                    whole = []
                    for base in (_B1, _B2):
                        acc, down = x.sums(base), _powers(len(x.words) + 1, _INVERSE[base])
                        whole.append(x.spans(x.first[:-1], x.first[1:], base, acc, down).view(np.int64))
                    short, beside, keys = _short_lines(x, whole[0], min_words)
                    used = (beside >= 0).T
                    pick = used.any(axis=1)
                    offs = np.concatenate([[0], np.cumsum(used[pick].sum(axis=1))]).astype(np.int32)
                    short, listed = short[pick], pa.ListArray.from_arrays(pa.array(offs), pa.array(keys.T[used]))
                    columns = [*fields(short), pa.array(whole[0][short]), pa.array(whole[1][short]), pa.nulls(len(short), pa.list_(pa.int64())), listed]
                    yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    return _texts(docs).mapInArrow(run, "doc_id long, t long, no int, n int, h1 long, h2 long, ends array<long>" + ", keys array<long>" * short_runs)


def _variants(candidates: DataFrame) -> DataFrame:
    """(v, pos, at): the key of each candidate (pos -1) and of it without its word ``pos``."""
    at_type = candidates.schema["at"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, blobs = _column(batch, "at"), _column(batch, "words")
            sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(sizes):  # about a million variants at once
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), side="right")))
                n = sizes[lo:hi]
                w = np.frombuffer(b"".join(blobs.slice(lo, hi - lo).to_pylist()), dtype=np.uint64)
                end = np.cumsum(n)
                start = end - n
                acc = np.zeros(len(w) + 1, dtype=np.uint64)
                np.add.accumulate(w * _powers(len(w), _B1), out=acc[1:])
                down = _powers(len(w) + 1, _INVERSE[_B1])
                own = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(w))
                cut = (acc[j] - acc[start][own] + (acc[end][own] - acc[j + 1]) * np.uint64(_INVERSE[_B1])) * down[start][own]
                keys = mix64(np.concatenate([(acc[end] - acc[start]) * down[start] + n.astype(np.uint64), cut + (n[own] - 1).astype(np.uint64)]))
                pos = np.concatenate([np.full(len(n), -1), j - start[own]]).astype(np.int32)
                line = np.concatenate([np.arange(len(n)), own]) + lo
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), at.take(pa.array(line))], ["v", "pos", "at"])
                lo = hi
        trim()

    return candidates.select("at", "words").mapInArrow(run, f"v long, pos int, at {at_type}")


def _pair_variants(candidates: DataFrame, least: int) -> DataFrame:
    """(v, dels, g1, g2, at): the keys of each candidate of ``least`` words or more with 0, 1 and 2 words deleted.

    ``g1``, ``g2``: the words that are left before each deleted one.
    """
    at_type = candidates.schema["at"].dataType.simpleString()

    def rows(at, i, parts):
        keys, dels, g1, g2 = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(dels), pa.array(g1, mask=g1 < 0), pa.array(g2, mask=g2 < 0), at.take(pa.array(np.full(len(keys), i)))], ["v", "dels", "g1", "g2", "at"])

    def run(batches):
        for batch in batches:
            at, blobs = _column(batch, "at"), _column(batch, "words")
            for i in range(batch.num_rows):
                w = np.frombuffer(blobs[i].as_buffer(), dtype=np.uint64)
                n = len(w)
                if n < least:
                    continue
                acc = np.zeros(n + 1, dtype=np.uint64)
                np.add.accumulate(w * _powers(n, _B1), out=acc[1:])
                back = np.uint64(_INVERSE[_B1])
                j = np.arange(n)
                none = np.full(n, -1, np.int32)
                one = acc[j] + (acc[n] - acc[j + 1]) * back
                parts = [(mix64(acc[n:] + np.uint64(n)), np.zeros(1, np.int32), none[:1], none[:1]), (mix64(one + np.uint64(n - 1)), none + 2, j.astype(np.int32), none)]
                size = n + 1
                for p in range(n - 1):
                    q = j[p + 1 :]
                    two = acc[p] + ((acc[q] - acc[p + 1]) + (acc[n] - acc[q + 1]) * back) * back
                    parts.append((mix64(two + np.uint64(n - 2)), np.full(len(q), 2, np.int32), np.full(len(q), p, np.int32), (q - 1).astype(np.int32)))
                    size += len(q)
                    if size >= 1 << 18:
                        yield rows(at, i, parts)
                        parts, size = [], 0
                if parts:
                    yield rows(at, i, parts)
        trim()

    return candidates.select("at", "words").mapInArrow(run, f"v long, dels int, g1 int, g2 int, at {at_type}")


def _two_edits(candidates: DataFrame, least: int) -> DataFrame:
    """(at, m): an earlier line within two edits, for lines of ``least`` words or more.

    Two lines that leave the same words are within two edits if they lose 0 and 1, 0 and 2, or 1 and 1 words; if they lose 1 and
    2, when the one word stood where one of the two did; if both lose 2, when both stood at the same places.
    """
    rows = written(_pair_variants(candidates, least))
    twice = rows.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v")
    rows = written(rows.join(twice.hint("merge"), "v", "left_semi"))
    low = lambda n: F.min(F.when(F.col("dels") == n, F.col("at"))).alias(f"m{n}")
    by_key = rows.join(rows.groupBy("v").agg(low(0), low(1), low(2)).hint("merge"), "v")
    by_key = by_key.select("at", F.when(F.col("dels") == 0, F.least("m1", "m2")).when(F.col("dels") == 1, F.least("m0", "m1")).otherwise(F.col("m0")).alias("m"))
    places = rows.where("dels > 0").select("v", "dels", "at", F.explode(F.array_distinct(F.array_compact(F.array("g1", "g2")))).alias("g"))
    by_place = places.join(places.groupBy("v", "g").agg(low(1), low(2)).hint("merge"), ["v", "g"]).select("at", F.when(F.col("dels") == 1, F.col("m2")).otherwise(F.col("m1")).alias("m"))
    both = rows.where("dels = 2")
    by_both = both.join(both.groupBy("v", "g1", "g2").agg(F.min("at").alias("m")).hint("merge"), ["v", "g1", "g2"]).select("at", "m")
    return by_key.unionByName(by_place).unionByName(by_both).where("m < at")


def within(x: np.ndarray, y: np.ndarray, bound: int) -> bool:
    """Edit distance of two word sequences is at most ``bound``."""
    if abs(len(x) - len(y)) > bound:
        return False
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    if not len(differ):
        return True
    if not bound:
        return False
    p = int(differ[0])
    return within(x[p + 1 :], y[p + 1 :], bound - 1) or within(x[p:], y[p + 1 :], bound - 1) or within(x[p + 1 :], y[p:], bound - 1)


def _verified(pairs: DataFrame, bound: int, per_words: int) -> DataFrame:
    def near(x: np.ndarray, y: np.ndarray) -> bool:
        return within(x, y, min(bound, min(len(x), len(y)) // per_words))

    def run(batches):
        for batch in batches:
            va, vb = _column(batch, "va"), _column(batch, "vb")
            ok = [near(np.frombuffer(va[i].as_buffer(), np.uint64), np.frombuffer(vb[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)]
            keep = pa.array(np.array(ok, dtype=bool))
            yield pa.RecordBatch.from_arrays([_column(batch, "b").filter(keep), _column(batch, "a").filter(keep)], ["at", "of"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"at {kind}, of {kind}")


def duplicate_lines(docs: DataFrame, min_words: int = 1, bound: int = 1, per_words: int = 8, short_runs: bool = False) -> DataFrame:
    """(doc_id, t, no, h1): every line that goes, with the hash of its text and that of its words; see the module's text.

    With ``short_runs`` also the repeated shorter lines, with the key that repeats; whether their neighbours go is for
    ``drop_lines``, which sees both.
    """
    if bound not in (0, 1, 2) or per_words < 2:
        raise ValueError("bound must be 0, 1 or 2, and per_words 2 or more")
    place = F.struct(F.col("doc_id").isNull().alias("x"), F.coalesce("doc_id", F.lit(0)).alias("d"), "t", F.col("no").alias("l"))
    lines = written(_scan(docs, min_words, per_words, short_runs).withColumn("at", place))
    if short_runs:
        keyed = lines.where("keys is not null").select("doc_id", "t", "no", "at", "h2", F.explode("keys").alias("key"))
        firsts = written(keyed.groupBy("key", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last"))
        repeated = keyed.join(firsts, ["key", "h2"]).where("first < at").select("doc_id", "t", "no", F.col("key").alias("h1"))
        lines = lines.where("keys is null").drop("keys")
    classes = written(lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("ends").alias("ends"), F.first("n").alias("n"), F.count("*").alias("copies")))
    if bound:
        near = _near(docs, classes, bound, per_words)
        judged = classes.join(near.hint("merge"), "at", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    else:
        judged = classes.withColumn("near", F.lit(False))
    # every later copy of a class goes; its first line goes if an earlier line is near
    judged = judged.where("copies > 1 or near").select("h1", "h2", F.col("at").alias("first"), "near")
    gone = lines.join(judged, ["h1", "h2"]).where("near or first < at").select("doc_id", "t", "no", "h1")
    return gone.unionByName(repeated) if short_runs else gone


def _near(docs: DataFrame, classes: DataFrame, bound: int, per_words: int) -> DataFrame:
    """(at, near): first lines of classes that have an earlier line near them."""
    # ends shared with another class
    ends = classes.select("at", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.count("*").alias("c")).where("c > 1").select("end")
    wanted = ends.join(shared.hint("merge"), "end", "left_semi").select("at").distinct()
    if bound > 1:
        wanted = wanted.unionByName(classes.where(F.col("n") >= bound * per_words).select("at")).distinct()
    per_doc = wanted.groupBy(F.col("at.x").alias("x"), F.col("at.d").alias("d"), F.col("at.t").alias("t")).agg(F.collect_set("at.l").alias("nos"))
    candidates = written(_line_words(docs, per_doc))
    # most variants belong to one line; a count of the keys alone sends those no further
    variants = written(_variants(candidates))
    twice = variants.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v")
    variants = written(variants.join(twice.hint("merge"), "v", "left_semi"))
    # earliest per (key, position), then per key; both combine before their shuffles
    by_pos = variants.groupBy("v", "pos").agg(F.min("at").alias("m"))
    by_key = by_pos.groupBy("v").agg(F.min(F.when(F.col("pos") < 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("pos") >= 0, F.col("m"))).alias("cut")).where("whole is not null")
    same = variants.where("pos >= 0").join(by_pos.hint("merge"), ["v", "pos"]).where("m < at").select("at", "m")
    longer = variants.where("pos >= 0").join(by_key.select("v", "whole").hint("merge"), "v").where("whole < at").select("at", F.col("whole").alias("m"))
    shorter = variants.where("pos < 0").join(by_key.select("v", "cut").hint("merge"), "v").where("cut < at").select("at", F.col("cut").alias("m"))
    found = same.unionByName(longer).unionByName(shorter)
    if bound > 1:
        found = found.unionByName(_two_edits(candidates, bound * per_words))
    pairs = written(found.groupBy("at").agg(F.min("m").alias("m")).select(F.col("m").alias("a"), F.col("at").alias("b")))
    return _verified(with_values(pairs, candidates.select(F.col("at").alias("id"), F.col("words").alias("value"))), bound, per_words).select("at", F.lit(True).alias("near"))


def _line_words(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """(at, words): word hashes of the wanted lines, as little-endian bytes."""
    docs = _texts(docs).withColumns({"x": F.col("doc_id").isNull(), "d": F.coalesce("doc_id", F.lit(0))})
    joined = docs.join(per_doc.hint("merge"), ["x", "d", "t"]).select("x", "d", "t", "text", "nos")

    def run(batches):
        for batch in batches:
            text, nos = _column(batch, "text"), _column(batch, "nos").to_pylist()
            xs, ds, ts = (_column(batch, c).to_pylist() for c in ("x", "d", "t"))
            for lo, hi in slices(text):
                at, picked = [], []
                for i, t in enumerate(text.slice(lo, hi - lo).to_pylist()):
                    split = t.split("\n") if t is not None else []
                    for no in nos[lo + i]:
                        if no < len(split):
                            at.append({"x": xs[lo + i], "d": ds[lo + i], "t": ts[lo + i], "l": no})
                            picked.append(split[no])
                words = Words(*flat_text(pa.array(picked, pa.large_string())))
                blobs = words.hashes().tobytes()
                ends = pa.py_buffer((words.first * 8).astype(np.int32))
                binary = pa.Array.from_buffers(pa.binary(), len(picked), [None, ends, pa.py_buffer(blobs)])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.struct([("x", pa.bool_()), ("d", pa.int64()), ("t", pa.int64()), ("l", pa.int32())])), binary], ["at", "words"])

    return joined.mapInArrow(run, "at struct<x:boolean,d:bigint,t:bigint,l:int>, words binary").dropDuplicates(["at"])


def drop_lines(docs: DataFrame, gone: DataFrame, min_words: int = 1, short_runs: bool = False) -> DataFrame:
    """``docs`` without the lines of ``gone``, and the columns ``n_lines``, ``n_dropped`` and ``emptied`` (in place of any of these names).

    ``min_words`` and ``short_runs`` are those of ``duplicate_lines``.  ``emptied``: the text had words and has none left.
    """
    docs = docs.drop("n_lines", "n_dropped", "emptied")
    names = docs.columns
    lists = gone.groupBy("doc_id", "t").agg(F.collect_list(F.struct("no", "h1")).alias("gone")).select(F.col("doc_id").alias("of"), F.col("t").alias("of_t"), "gone")
    # the other columns travel as one struct, so no name of theirs can clash with a name in here
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[c for c in names if c != "text"]).alias("row"), F.col("doc_id").cast("long").alias("d"), text.alias("text"), F.xxhash64(text).alias("t"))
    joined = rows.join(lists.hint("merge"), F.col("d").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t")), "left").select("row", "text", "gone")
    schema = with_fields(joined.drop("gone").schema, "n_lines int, n_dropped int, emptied boolean")

    def run(batches):
        for batch in batches:
            text, gone = _column(batch, "text"), _column(batch, "gone")
            n_lines = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0).cast(pa.int32())
            n_dropped, emptied = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, dtype=bool)
            hit = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.list_value_length(gone), 0), False)))
            some, new = text.take(pa.array(hit)), []
            for lo, hi in slices(some):
                part = some.slice(lo, hi - lo)
                lines = Lines(part)
                acc, down = lines.sums(_B1), _powers(len(lines.words) + 1, _INVERSE[_B1])
                h1 = lines.spans(lines.first[:-1], lines.first[1:], _B1, acc, down).view(np.int64)
                short, beside, keys = _short_lines(lines, h1, min_words) if short_runs else (np.zeros(0, np.int64), None, None)
                for i, (value, row) in enumerate(zip(part.to_pylist(), hit[lo:hi].tolist())):
                    s, e = lines.starts[i], lines.starts[i + 1]
                    listed = gone[row].as_py()
                    out = {g["no"] for g in listed if s + g["no"] < e and h1[s + g["no"]] == g["h1"]}
                    lo_s, hi_s = np.searchsorted(short, (s, e))
                    if lo_s < hi_s:
                        repeats, long_out = {(g["no"], g["h1"]) for g in listed}, {-1, *(s + k for k in out)}
                        for j in range(lo_s, hi_s):
                            k, (before, after) = int(short[j] - s), beside[:, j].tolist()
                            if before in long_out and after in long_out and any(b >= 0 and (k, h) in repeats for b, h in zip((before, after), keys[:, j].tolist())):
                                out.add(k)
                    if value is not None and out:
                        value = "\n".join([t for k, t in enumerate(value.split("\n")) if k not in out])
                    new.append(value)
                    n_dropped[row] = len(out)
                    emptied[row] = bool(out) and not value.strip(" \t\n\r\x0b\x0c")
            mask = np.zeros(batch.num_rows, dtype=bool)
            mask[hit] = True
            new = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([_column(batch, "row"), new, n_lines, pa.array(n_dropped), pa.array(emptied)], ["row", "text", "n_lines", "n_dropped", "emptied"])
        trim()

    out = joined.mapInArrow(run, schema)
    own = {"text": F.col("text")}
    if "n_chars" in names:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[own.get(c, F.col("row").getField(c).alias(c)) for c in names], "n_lines", "n_dropped", "emptied")
