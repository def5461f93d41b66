"""Phrase collocations by hashed candidate passes (PCY/DHP).

Pass k counts phrases of k words exactly and, over the same texts, counts the phrases of k + 1 words in hash buckets.  A phrase of
k words is counted only if its bucket of the pass before reached ``support`` and the two phrases of k - 1 words inside it are
frequent (Apriori).  Both tests are bitmaps of a fixed number of bits, so what is broadcast has a bound whatever the corpus; a
bit that is set by chance costs a count that is dropped later, never a phrase.  Beyond ``MAX_BUCKETS`` * ``support`` phrases the
buckets fill up and only the Apriori test cuts; results stay the same.

A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``.  Everything is
counted for each lang by itself.  The score of a phrase with a occurrences, of n words in all, is that of its worst cut into parts
with l and r occurrences: floor(1000 * a * n / (l * r)), in decimals of 38 digits.  A phrase inside a longer one that has at
least ``covered`` percent of its occurrences is dropped.

Cases: null texts are empty; a null lang is ``und``; rows count as often as they come, also repeated rows and null doc_ids (ids are not
read); other columns are not read either.  Words of any length and texts of any length take part whole.  Ties of cuts go to the
first cut, ties of phrases to UTF-8 byte order.  Empty tables and langs without a phrase give no rows.  Within a slice of 2 MB words
and phrases are told apart by 64-bit hashes (two differ with a chance under 1e-8 a slice), between slices by their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytes_np import Words, flat_text, mix64
from .pair_join import hot_join
from .store import slices, trim, written

LONGEST = 5
#: Buckets of a pass: one for each ``BYTES_A_BUCKET`` bytes of text, within these bounds (powers of two).
MIN_BUCKETS, MAX_BUCKETS, BYTES_A_BUCKET = 1 << 22, 1 << 26, 128
_CHUNK = 1 << 16
SALTS = 32
#: Tasks whose bucket counts are added up in one step.
_FAN_IN = 256
_SLICE = 2 << 20

_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_SEPARATOR = _BREAK | np.isin(np.arange(256), [32, 9])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLOTS = mix64(np.arange(701, 701 + LONGEST, dtype=np.uint64)) | np.uint64(1)


class Phrases:
    """Words of a slice and the hashes of the phrases that begin at each of them."""

    def __init__(self, text: pa.Array, lang: pa.Array) -> None:
        raw, offsets = flat_text(text)
        self.words = words = Words(raw, offsets, _SEPARATOR)
        self.hash = words.hashes()
        breaks = np.cumsum(_BREAK[raw], dtype=np.int32)[words.start]
        new = np.zeros(len(self.hash), dtype=bool)
        new[1:] = (np.diff(breaks) > 0) | (np.diff(words.doc) > 0)
        self.piece = np.cumsum(new)
        names = lang.dictionary_encode() if not isinstance(lang, pa.DictionaryArray) else lang
        self.langs = names.dictionary.to_pylist()
        self.lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.doc] if len(words.doc) else np.zeros(0, np.int64)
        salts = Words(*flat_text(names.dictionary), np.zeros(256, dtype=bool)).hashes(lower=False) if len(self.langs) else np.zeros(0, np.uint64)
        by_lang = np.zeros(len(self.langs) + 1, dtype=np.uint64)
        by_lang[[i for i, name in enumerate(self.langs) if name]] = salts
        self.salt = by_lang[self.lang]

    def inside(self, k: int) -> np.ndarray:
        """Words at which a phrase of k words lies in one piece."""
        n = len(self.hash) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        acc = self.salt[at] + np.uint64(k)
        for j in range(k):
            acc += self.hash[at + j] * _SLOTS[j]
        return mix64(acc)

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words at ``at``: lower-cased words, joined by a space."""
        which = (at[:, None] + np.arange(k)).ravel()
        begin, size = self.words.start[which], self.words.end[which] - self.words.start[which]
        step = size + 1  # each word and the space behind it; the last space of a phrase is left out
        ends = np.cumsum(step)
        source = np.repeat(begin - (ends - step), step) + np.arange(ends[-1] if len(ends) else 0)
        flat = np.append(self.words.raw, np.uint8(32))[np.minimum(source, len(self.words.raw))]
        flat = _LOWER[flat]
        flat[ends - 1] = 32
        stop = ends[k - 1 :: k] - 1
        keep = np.ones(len(flat), dtype=bool)
        keep[stop] = False
        offsets = np.concatenate([[0], stop - np.arange(len(stop))]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat[keep])])


class Bits:
    """A bitmap over hashes, of a power of two of bits."""

    def __init__(self, packed: np.ndarray) -> None:
        self.packed, self.mask = packed, np.uint64(8 * len(packed) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).astype(np.int64)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class _Buckets:
    """Saturating counts of a task's buckets; given out in chunks."""

    def __init__(self, size: int, dtype: str) -> None:
        self.size, self.most, self.counts = size, np.iinfo(dtype).max, np.zeros(size, dtype=dtype)

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique((hashes & np.uint64(self.size - 1)).astype(np.int64), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + n, self.most)

    def batches(self, part: int):
        for lo in range(0, self.size, 64 * _CHUNK):
            chunks = [(c, self.counts[c * _CHUNK : (c + 1) * _CHUNK]) for c in range(lo // _CHUNK, min(self.size, lo + 64 * _CHUNK) // _CHUNK)]
            chunks = [(c, x.tobytes()) for c, x in chunks if x.any()]
            yield [c for c, _ in chunks], [part] * len(chunks), [x for _, x in chunks]


_PASS = "lang string, phrase string, n int, chunk int, part int, counts binary"
_NAMES = [c.split()[0] for c in _PASS.split(", ")]


def _counted(found: Phrases, at: np.ndarray, hashes: np.ndarray, k: int) -> pa.RecordBatch:
    _, first, n = np.unique(hashes, return_index=True, return_counts=True)
    first = at[first]
    langs = pa.DictionaryArray.from_arrays(pa.array(found.lang[first], pa.int32()), pa.array(found.langs, pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, found.texts(first, k).cast(pa.string()), pa.array(n.astype(np.int32)), *_no_buckets(len(n))], _NAMES)


def _no_phrases(n: int) -> list[pa.Array]:
    return [pa.nulls(n, t) for t in (pa.string(), pa.string(), pa.int32())]


def _no_buckets(n: int) -> list[pa.Array]:
    return [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary())]


def _pass(docs: DataFrame, k: int, buckets: int, dtype: str, frequent, open_buckets) -> DataFrame:
    """One pass over the texts: rows of exact counts of phrases of k words, then the task's bucket counts of k + 1 words.

    At k = 1 a row without a phrase holds the number of words of a lang in the slice.
    """

    def run(batches):
        ahead = _Buckets(buckets, dtype) if k < LONGEST else None
        for batch in batches:
            for lo, hi in slices(batch.column(1), _SLICE):
                part = batch.slice(lo, hi - lo)
                found = Phrases(part.column(1), part.column(0))
                at = found.inside(k)
                hashes = found.hashes(at, k)
                here = np.zeros(len(found.hash) + 1, dtype=bool)
                if k == 1:
                    here[at] = True
                    totals = np.bincount(found.lang, minlength=len(found.langs))
                    yield pa.RecordBatch.from_arrays([pa.array(found.langs, pa.string()), pa.nulls(len(totals), pa.string()), pa.array(totals.astype(np.int32)), *_no_buckets(len(totals))], _NAMES)
                else:
                    known = np.zeros(len(found.hash) + 1, dtype=bool)
                    inner = found.inside(k - 1)
                    known[inner] = frequent.value.has(found.hashes(inner, k - 1))
                    keep = known[at] & known[at + 1] & open_buckets.value.has(hashes)
                    at, hashes = at[keep], hashes[keep]
                    here[at] = True
                if len(at):
                    yield _counted(found, at, hashes, k)
                if ahead is not None:
                    longer = found.inside(k + 1)
                    longer = longer[here[longer] & here[longer + 1]]
                    ahead.add(found.hashes(longer, k + 1))
        if ahead is not None:
            part = TaskContext.get().partitionId()
            for chunk, of, counts in ahead.batches(part):
                yield pa.RecordBatch.from_arrays([*_no_phrases(len(chunk)), pa.array(chunk, pa.int32()), pa.array(of, pa.int32()), pa.array(counts, pa.binary())], _NAMES)
        trim()

    return docs.mapInArrow(run, _PASS)


def _bitmap(blobs: DataFrame, parts: int, buckets: int, dtype: str, at_least: int) -> Bits:
    """The buckets that reach ``at_least``, from the (chunk, part, counts) of ``parts`` tasks; counts are added up as they stream by, and saturate."""
    most = np.iinfo(dtype).max

    def add(keyed: DataFrame, last: bool) -> DataFrame:
        def run(batches):
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for c, p, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    x = np.frombuffer(x, dtype=dtype)
                    have = sums.get((c, p))
                    sums[c, p] = x if have is None else np.minimum(have.astype(np.int64) + x, most).astype(dtype)
            for (c, p), x in sums.items():
                out = np.packbits(x >= at_least, bitorder="little") if last else x
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([p], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["chunk", "part", "counts"])

        return keyed.mapInArrow(run, "chunk int, part int, counts binary")

    if parts > _FAN_IN:
        blobs = add(blobs.withColumn("part", F.floor(F.col("part") / _FAN_IN).cast("int")).repartition("chunk", "part"), last=False)
    return _packed(add(blobs.withColumn("part", F.lit(0)).repartition("chunk"), last=True).select("chunk", "counts"), buckets, _CHUNK)


def _packed(rows: DataFrame, buckets: int, chunk: int) -> Bits:
    """A bitmap from rows (number, bits) of its chunks; one bit for each bucket, of which there are at most MAX_BUCKETS."""
    packed = np.zeros(buckets // 8, dtype=np.uint8)
    for number, bits in rows.collect():
        packed[number * chunk // 8 : (number + 1) * chunk // 8] = np.frombuffer(bits, dtype=np.uint8)
    return Bits(packed)


def _frequent_bits(phrases: DataFrame, k: int, buckets: int) -> Bits:
    """A bitmap of the hashes of frequent phrases of k words, of as many bits as there are buckets."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), _SLICE):
                part = batch.slice(lo, hi - lo)
                found = Phrases(part.column(1), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(found.hashes(found.inside(k), k).view(np.int64))], ["hash"])

    wide = 8 * 4096  # bits of Spark's bitmaps
    at = F.col("hash").bitwiseAND(F.lit(buckets - 1))
    chunks = phrases.select("lang", "phrase").mapInArrow(run, "hash long").select(F.shiftright(at, wide.bit_length() - 1).alias("number"), (at % wide).alias("at")).groupBy("number").agg(F.bitmap_construct_agg("at").alias("bits"))
    return _packed(chunks, buckets, wide)


def frequent_phrases(docs: DataFrame, support: int = 100, longest: int = LONGEST, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all phrases of 1 to ``longest`` words with f >= support, (lang, n) of every lang with a word)."""
    if support < 1 or not 2 <= longest <= LONGEST:
        raise ValueError(f"support is at least 1, longest 2 to {LONGEST}")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (size // BYTES_A_BUCKET).bit_length()))
    dtype = next(t for t in ("uint8", "uint16", "uint32") if support <= np.iinfo(t).max)
    frequent = open_buckets = every = totals = None
    for k in range(1, longest + 1):
        # read twice, then gone: blocks on the executors' disks, which a lost executor costs one pass over its texts
        raw = _pass(docs, k, buckets, dtype, frequent, open_buckets).persist(StorageLevel.DISK_ONLY)
        counts = raw.where("chunk is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            counts = written(counts.where(f"phrase is null or f >= {support}"))
            totals = counts.where("phrase is null and f > 0").select("lang", F.col("f").alias("n"))
            counts = counts.where("phrase is not null")
        else:
            counts = written(counts.where(f"f >= {support}"))
        found = counts.select("lang", "phrase", F.lit(k).alias("k"), "f")
        every = found if every is None else every.unionByName(found)
        for old in (frequent, open_buckets):
            if old is not None:
                old.unpersist()
        last = k == longest or counts.isEmpty()
        if not last:
            blobs = raw.where("chunk is not null").select("chunk", "part", "counts")
            parts = (blobs.agg(F.max("part")).first()[0] or 0) + 1
            open_buckets = spark.sparkContext.broadcast(_bitmap(blobs, parts, buckets, dtype, support))
            frequent = spark.sparkContext.broadcast(_frequent_bits(counts, k, buckets))
        raw.unpersist()
        if last:
            break
    return every, totals


def collocations(docs: DataFrame, support: int = 100, longest: int = LONGEST, covered: int = 100, top: int = 2000, buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each lang by score, occurrences and text; see the module's text."""
    every, totals = frequent_phrases(docs, support, longest, buckets)
    phrases = every.where("k > 1").withColumn("w", F.split("phrase", " "))
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")

    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = written(cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail")))
    for side, name in (("head", "l"), ("tail", "r")):
        # a frequent word heads or ends a good part of all phrases
        asked = cuts.groupBy("lang", side).agg(F.count("*").alias("rows"))
        values = written(every.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)).join(asked, ["lang", side]))
        cuts = written(hot_join(cuts, values, ["lang", side], "rows"))
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    scored = cuts.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    scored = scored.select("*", ((F.lit(1000) * F.col("a")).cast("decimal(19,0)") * wide("n")).alias("over"), (wide("l") * wide("r")).alias("under")).withColumn("score", F.expr("over div under"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")

    spans = phrases.where("k > 2").select("lang", "w", "k", "f", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    spans = spans.select("lang", "w", "f", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    longer = spans.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("within"))
    kept = worst.join(longer, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.lit(100) * F.col("within") < F.lit(covered) * F.col("a")))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    # a lang's rows are cut to ``top`` for each salt first, so its one task reads at most SALTS * top rows
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_WORDS = r"regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09]+')"
ORACLE_SQL = rf"""
with p as (
  select lang, {_WORDS} as w from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(coalesce(text, ''), '[.,;:!?\x0A-\x0D]')) as piece from documents)
), s as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p cross join (select unnest(range(1, 6)) as k) where len(w) >= k)
), n as (
  select lang, count(*) as n from s where k = 1 group by 1
), f as materialized (
  select lang, k, phrase, count(*) as f from s group by all having count(*) >= 100
), c as (
  select *, string_split(phrase, ' ') as w, unnest(range(1, k)) as cut from f where k > 1
), j as (
  select c.lang, c.phrase, c.cut, c.f as a, x.f as l, y.f as r, n.n, ((1000::hugeint * c.f * n.n) // (x.f::hugeint * y.f))::bigint as score from c join n using (lang)
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[:c.cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), m as (
  select * from j qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), b as (
  select distinct lang, array_to_string(w[i:i + size - 1], ' ') as phrase, f from (select *, unnest(range(1, k - size + 2)) as i from (select lang, k, f, string_split(phrase, ' ') as w, unnest(range(2, k)) as size from f where k > 2))
), g as (
  select m.* from m where not exists (select 1 from b where b.lang = m.lang and b.phrase = m.phrase and 100 * b.f >= 100 * m.a)
), r as (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from g
)
select * from r where rank <= 2000
"""
