"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds its distinct ``width``-word shingles (A-Z lower-cased, words are runs of characters other
than space and U+0009-000D); with fewer words the whole sequence is the one shingle; without words it is empty.

Plan
1. One Arrow pass over the texts makes shingle hashes, a 128-bit fingerprint of the set and the band keys.
   Rows with equal sets become one class at once (map-side combined), so copies are never compared.  A class has a number of
   its own and one row that stands for it: the smallest (doc_id, hash of the text).
2. Classes that share a band key form a bucket.  Buckets are never expanded into pairs.  In each of
   ``leader_rounds`` rounds a bucket compares one leader, its most connected member, with the members of other
   components; verified pairs merge components, and a leader is then settled.
3. Members of different components that no leader settled go through an exact prefix-filter join over
   their rarest shingles, which finds every pair that can still reach the threshold.
Every link is confirmed on the full shingle sets (64-bit shingle hashes); equal sets are one class by their size and
fingerprint alone.  With 16 bands of 4 rows a pair at similarity 0.85 shares a band with probability 1 - 7e-6; that is the
only loss.

Cases: null or empty text, or white space only: n_shingles 0, linked with nothing.  Repeated doc_id: ``near_duplicates`` takes
its rows as one document, so they have one component, which holds the links of all its texts; one row per input row.
``representatives`` takes every row by itself.  Null doc_id: ``near_duplicates`` keeps the row with null component and links it
with nothing; ``representatives`` treats it like other rows, after those with an id.  Empty table: no rows.  Other columns are
ignored by ``near_duplicates`` and returned as they are by ``representatives``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import Words, flat_text, mix64, shingle_hashes
from .components import connected
from .pair_join import hot_join, with_values
from .store import slices, trim, written
from .superminhash import band_keys, signatures


#: Rows of a shingle in a part of the exact join.
PART_ROWS = 1024


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of many rows, starts)."""
    for lo, hi in slices(column):
        words = Words(*flat_text(column.slice(lo, hi - lo)))
        sh, st = shingle_hashes(words.hashes(), words.first, width)
        per_row = [np.unique(sh[a:b]) for a, b in zip(st[:-1], st[1:])]
        yield lo, np.concatenate(per_row), np.concatenate([[0], np.cumsum([len(x) for x in per_row])])


def _segment_sum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(x) + 1, dtype=np.uint64)
    np.add.accumulate(x, out=acc[1:])
    return acc[starts[1:]] - acc[starts[:-1]]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _hashes(sh: np.ndarray, st: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify each set."""
    f1, f2 = (_segment_sum(mix64(sh ^ np.uint64(s)), st).view(np.int64) for s in (0x51ED, 0xA3C7F00D))
    return f1, f2


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t): ``t`` tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("t", F.xxhash64("text"))


def fingerprints(docs: DataFrame, width: int = 5, components: int = 64, bands: int = 16) -> DataFrame:
    """(doc_id, t, n_shingles, f1, f2, keys): hash of the text, set size, two sums that identify the set, band keys (null when empty)."""

    def run(batches):
        for batch in batches:
            ids, text, t = (_column(batch, c) for c in ("doc_id", "text", "t"))
            for lo, sh, st in _sets(text, width):
                n = np.diff(st)
                f1, f2 = _hashes(sh, st)
                keys = band_keys(signatures(sh, st, components), bands)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                keys = pa.compute.if_else(pa.array(n > 0), flat, pa.scalar(None, flat.type))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(n)), t.slice(lo, len(n)), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), keys], ["doc_id", "t", "n_shingles", "f1", "f2", "keys"])
        trim()

    import pyarrow.compute  # noqa: F401

    return _keyed(docs).mapInArrow(run, "doc_id long, t long, n_shingles long, f1 long, f2 long, keys array<long>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted(rep, doc_id, t, f1, f2)`` -> (rep, shingles): sorted uint64 hashes as little-endian bytes, of the row that stands for each class.

    A text whose hash only looks like that of the wanted row has other sums and goes.  The wanted rows grow with the input, so
    they are merged with the texts and never broadcast.
    """
    joined = _keyed(docs).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t"))).select("rep", "f1", "f2", "text")

    def run(batches):
        for batch in batches:
            rep, text, f1, f2 = (_column(batch, c) for c in ("rep", "text", "f1", "f2"))
            for lo, sh, st in _sets(text, width):
                n = len(st) - 1
                g1, g2 = _hashes(sh, st)
                own = pa.array((f1.slice(lo, n).to_numpy() == g1) & (f2.slice(lo, n).to_numpy() == g2))
                blob = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((st * 8).astype(np.int64)), pa.py_buffer(sh.tobytes())])
                yield pa.RecordBatch.from_arrays([rep.slice(lo, n).filter(own), blob.cast(pa.binary()).filter(own)], ["rep", "shingles"])
        trim()

    return joined.mapInArrow(run, "rep long, shingles binary").dropDuplicates(["rep"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets have ``100 * |intersection| >= percent * |union|``.

    The side ``a`` may be one document with a large part of all pairs.
    """
    both = with_values(pairs, sets.select(F.col("rep").alias("id"), F.col("shingles").alias("value")))

    def run(batches):
        for batch in batches:
            a, b, sa, sb = (_column(batch, c) for c in ("a", "b", "va", "vb"))
            keep, last, x = np.zeros(batch.num_rows, dtype=bool), None, None
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, x = a[i], np.frombuffer(sa[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(sb[i].as_buffer(), dtype=np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _with_component(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return members.withColumn("comp", F.col("rep"))
    return members.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _prefix_pairs(sets: DataFrame, open_reps: DataFrame, percent: int) -> DataFrame:
    """Exact candidate pairs of different components among ``open_reps(rep, comp)``.

    Shingles are ordered by their number of open documents.  Two sets at or over the threshold share one of
    the first ``n - ceil(percent * n / 100) + 1`` shingles of each; shingles of one document only match nothing,
    so a document with enough of those is out.
    """
    own = sets.join(open_reps, "rep")

    def explode(batches):
        for batch in batches:
            rep, comp, blob = _column(batch, "rep").to_numpy(), _column(batch, "comp").to_numpy(), _column(batch, "shingles")
            for i in range(batch.num_rows):
                sh = np.frombuffer(blob[i].as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sh), rep[i])), pa.array(np.full(len(sh), comp[i])), pa.array(np.full(len(sh), len(sh), dtype=np.int64)), pa.array(sh)], ["rep", "comp", "n", "sh"])

    rows = written(own.select("rep", "comp", "shingles").mapInArrow(explode, "rep long, comp long, n long, sh long"))
    often = written(rows.groupBy("sh").agg(F.count("*").alias("c")).where("c > 1"))
    listed = rows.join(often, "sh").groupBy("rep", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("c", "sh"))).alias("common"))
    least = F.ceil(F.col("n") * percent / 100)  # smallest overlap with any partner
    take = F.col("n") - least + 1 - (F.col("n") - F.size("common"))
    heads = listed.where(take > 0).select("rep", "comp", "n", (F.col("n") - F.size("common")).alias("alone"), F.posexplode(F.slice("common", 1, take.cast("int"))).alias("at", "x"))
    # the rows of a frequent shingle are cut into parts, and every pair of parts is a group of its own
    parts = F.ceil(F.col("x.c") / F.lit(PART_ROWS)).cast("int")
    heads = heads.select("rep", "comp", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), F.col("x.sh").alias("sh"), F.sequence(F.lit(0), parts - 1).alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"))
    heads = written(heads)
    x = heads.select("rep", "comp", "n", "rest", "sh", F.col("part").alias("i"), F.explode("parts").alias("j")).alias("x")
    y = heads.select("rep", "comp", "n", "rest", "sh", F.explode("parts").alias("i"), F.col("part").alias("j")).alias("y")
    overlap = F.lit(percent) * (F.col("x.n") + F.col("y.n"))
    fits = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & (F.least("x.rest", "y.rest") * (100 + percent) >= overlap)
    fits &= F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    same = (F.col("x.sh") == F.col("y.sh")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    return x.join(y, same & fits).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _grouped(prints: DataFrame, docs: DataFrame, width: int, percent: int, leader_rounds: int, by_id: bool) -> DataFrame:
    """Classes of ``prints`` (rows with words) and their groups: (rep, f1, f2, n_shingles, low, copies, group), a written table.

    ``low`` is the smallest (no id, doc_id, t) of the class.  ``by_id``: classes that share a doc_id are linked.
    """
    low = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), "t")).alias("low")
    # all rows of a class have the same keys; the number stays with the class once the table is written
    classes = prints.groupBy("f1", "f2", "n_shingles").agg(low, F.first("keys").alias("keys"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()))
    links, groups, tested = None, None, None
    if by_id:
        one = F.struct("f1", "f2", "n_shingles")
        several = written(prints.groupBy("doc_id").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("doc_id"))
        if not several.isEmpty():
            of_id = prints.join(several.hint("merge"), "doc_id").join(classes.select("rep", "f1", "f2", "n_shingles"), ["f1", "f2", "n_shingles"]).select("doc_id", "rep").distinct()
            links = written(of_id.groupBy("doc_id").agg(F.min("rep").alias("a")).join(of_id, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct())
            groups = written(connected(links))
    member = written(classes.select("rep", F.col("n_shingles").alias("n"), F.explode("keys").alias("key")))
    # written, so that the join's sides are plain exchanges and a hot key's partition can be split
    shared = written(member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    member = member.join(shared, "key")
    popular = member.groupBy("rep").agg(F.sum("size").alias("pop"))
    member = written(member.drop("size").join(popular, "rep").withColumn("settled", F.lit(False)))
    wanted = classes.select("rep", F.col("low.d").alias("of"), F.col("low.t").alias("of_t"), "f1", "f2").join(member.select("rep").distinct(), "rep", "left_semi")
    near = written(_shingle_sets(docs, wanted, width))

    for _ in range(leader_rounds):
        now = _with_component(member, groups)
        leads = now.where("not settled").groupBy("key").agg(F.max(F.struct("pop", (-F.col("rep")).alias("low"), "comp", "n")).alias("lead"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        leads = written(leads.select("key", (-F.col("lead.low")).alias("a"), F.col("lead.comp").alias("ca"), F.col("lead.n").alias("na")))
        pairs = now.join(leads, "key").where((F.col("comp") != F.col("ca")) & (F.least("n", "na") * 100 >= F.greatest("n", "na") * percent)).select("a", F.col("rep").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        pairs = written(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = written(_verified(pairs, near, percent))
        links = found if links is None else links.unionByName(found)
        groups = written(connected(links))
        done = leads.select("key", F.col("a").alias("rep"), F.lit(True).alias("led"))
        member = written(member.join(done, ["key", "rep"], "left").withColumn("settled", F.col("settled") | F.coalesce("led", F.lit(False))).drop("led"))

    now = _with_component(member.where("not settled"), groups)
    unsettled = written(now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key"))
    open_reps = written(now.join(unsettled, "key", "left_semi").select("rep", "comp").distinct())
    rest = written(_verified(written(_prefix_pairs(near, open_reps, percent)), near, percent))
    if not rest.isEmpty():
        groups = written(connected(rest if links is None else links.unionByName(rest)))
    classes = classes.drop("keys")
    if groups is None:
        return classes.withColumn("group", F.col("rep"))
    return written(classes.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("group", F.coalesce("component", "rep")).drop("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85, components: int = 64, bands: int = 16, leader_rounds: int = 2) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, n_shingles, component_id, kept); see the module's text."""
    prints = written(fingerprints(docs, width, components, bands))
    full = prints.where("n_shingles > 0 and doc_id is not null")
    classes = _grouped(full, docs, width, percent, leader_rounds, by_id=True)
    # the smallest doc_id of a group; groups of one class need no look-up
    least = classes.groupBy("group").agg(F.min("low.d").alias("component_id"), F.count("*").alias("rows"))
    named = written(hot_join(classes.select("group", "f1", "f2", "n_shingles", "copies"), least, ["group"], "rows").drop("group"))
    linked = hot_join(full.select("doc_id", "n_shingles", "f1", "f2"), named, ["f1", "f2", "n_shingles"], "copies").select("doc_id", "n_shingles", "component_id")
    blank = prints.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
    # a row without words has the component of the other rows of its doc_id, if there are any
    both = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most")).where("least = 0 and most > 0").select("doc_id")
    both = written(both)
    if both.isEmpty():
        blank = blank.withColumn("component_id", F.col("doc_id"))
    else:
        known = linked.join(both, "doc_id", "left_semi").select("doc_id", "component_id").distinct()
        blank = blank.join(known, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = linked.unionByName(blank)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, components: int = 80, bands: int = 20, leader_rounds: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies, the one with the smallest (doc_id, hash of the text), null ids last.

    Every row is judged by itself, so different texts of one doc_id all stay unless they are near copies.  Of rows equal in doc_id
    and text the smallest in its other columns stays.  Rows without words stay.
    """
    prints = written(fingerprints(docs, width, components, bands))
    classes = _grouped(prints.where("n_shingles > 0"), docs, width, percent, leader_rounds, by_id=False)
    first = written(classes.groupBy("group").agg(F.min("low").alias("low"), F.sum("copies").alias("copies")))
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("t"), _has_words(F.col("text").cast("string")).alias("full"))
    wanted = first.select(F.col("low.d").alias("of"), F.col("low.t").alias("of_t"), (F.col("copies") > 1).alias("several"))
    # rows without words are in no class
    found = rows.join(wanted.hint("merge"), F.col("d").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t")), "left")
    alone = found.where("not full or not several").select("row")
    # more rows than one may equal the chosen one; which of them stays does not depend on the order of rows
    equal = found.where("full and several").groupBy("d", "t", F.col("row.text").alias("text")).agg(F.min_by("row", F.to_json(F.col("row").dropFields("text"))).alias("row")).select("row")
    return alone.unionByName(equal).select(*[F.col("row")[c].alias(c) for c in names])


def _has_words(text):
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
