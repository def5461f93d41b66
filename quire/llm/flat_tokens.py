"""Flat token files: unsigned little-endian ids, 64-bit document offsets, prefix-sum bases.

A corpus is cut into buckets of neighbouring doc_ids, so many that a bucket holds about ``BUCKET_BYTES`` of text.  Bucket b has
``b.bin`` (the ids of its documents one after another), ``b.idx`` (uint64 position of every document's first id in the file, and
the end) ``b.doc`` (int64 doc_ids) and ``b.nul`` (uint64 places of the documents whose doc_id is null).  ``b.bin`` alone is a valid
unindexed file.  The position of a document in the whole corpus is its bucket's base, the sum of the sizes of the buckets before,
plus its offset.  Rows that share a doc_id, or have none, are cut into buckets by their texts' hashes when they are many.

Files are written beside their place and renamed, with the same bytes at every attempt, so a task that is run
again after a lost executor does no harm.  Readers take ranges of a file: mapped memory on a local store, bounded reads elsewhere.

Cases: null text is empty; a row without ids still has an offset; equal doc_ids follow each other in the
order of their texts' hashes; null doc_ids come last in doc_id order; an empty table gives a manifest without rows.  Rows equal in
doc_id and text stay in one bucket.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import slices

#: ``encode(texts) -> (flat ids, ids of each text)``, made anew in each worker.
Encoder = Callable[[list], tuple[np.ndarray, np.ndarray]]
MANIFEST = "bucket int, n_docs long, n_tokens long"
BATCH_IDS = 1 << 20
BUCKET_BYTES = 256 << 20
_LONG = (1 << 63) - 1


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


class _Out:
    """A file that appears under its name only when it is complete."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.store, self.path, self.tmp = store, path, f"{path}.{uuid.uuid4().hex}"
        self.stream = store.open_output_stream(self.tmp)

    def write(self, data: np.ndarray) -> None:
        self.stream.write(np.ascontiguousarray(data))

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.tmp, self.path)


class Flat:
    """Ranges of a flat file; nothing is read before it is asked for."""

    def __init__(self, store: fs.FileSystem, path: str, dtype: str) -> None:
        self.dtype = np.dtype(dtype)
        self.size = store.get_file_info(path).size // self.dtype.itemsize
        self.mapped = self.file = None
        if isinstance(store, fs.LocalFileSystem):
            self.mapped = np.memmap(path, dtype=self.dtype, mode="r") if self.size else np.zeros(0, self.dtype)
        else:
            self.file = store.open_input_file(path)

    def __len__(self) -> int:
        return self.size

    def read(self, lo: int, hi: int) -> np.ndarray:
        hi = min(hi, self.size)
        if self.mapped is not None:
            return np.asarray(self.mapped[lo:hi])
        step = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((hi - lo) * step, lo * step), dtype=self.dtype)

    def blocks(self, lo: int, hi: int, size: int = BATCH_IDS) -> Iterator[tuple[int, np.ndarray]]:
        """(position, ids) of consecutive blocks of a range."""
        for at in range(lo, hi, size):
            yield at, self.read(at, min(at + size, hi))


def _bounds(docs: DataFrame, buckets: int) -> list[tuple[int | None, int, int]]:
    """Buckets with about equal numbers of rows, from the doc_id column alone: (smallest doc_id, part, parts) of each, in order.

    A doc_id that fills buckets by itself is cut into ``parts`` by hash; the last ones (None) hold the rows without an id.
    """
    total, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    none = -(-(total - known) * buckets // max(total, 1))
    ids = max(1, buckets - none)
    got = docs.stat.approxQuantile("doc_id", [i / ids for i in range(1, ids)], 0.2 / ids) if ids > 1 and known else []
    starts: list[tuple[int | None, int, int]] = [(-_LONG - 1, 0, 1)]
    got = [min(int(x), _LONG) for x in got]  # quantiles are doubles
    for value in sorted(set(got)):
        parts = got.count(value)
        if parts > 1:
            starts += [(value, k, parts) for k in range(parts)] + [(value + 1, 0, 1)] * (value < _LONG)
        elif starts[-1][0] != value:
            starts.append((value, 0, 1))
    return starts + [(None, k, max(1, none)) for k in range(max(1, none))]


def _bucket(bounds: list[tuple[int | None, int, int]]):
    """Column: the bucket of each row."""
    firsts = [k for k, (value, part, _) in enumerate(bounds) if value is not None and part == 0]

    def parts(k: int):
        n = bounds[k][2]
        if n == 1:
            return F.lit(k)
        share = F.xxhash64("text").cast("double") / F.lit(float(1 << 64)) + 0.5  # rises with the hash
        return (F.lit(k) + F.least(F.floor(share * n), F.lit(n - 1))).cast("int")

    def tree(lo: int, hi: int):  # a search tree over the first doc_ids
        if lo == hi:
            return parts(firsts[lo])
        mid = (lo + hi + 1) // 2
        return F.when(F.col("doc_id") < F.lit(bounds[firsts[mid]][0]), tree(lo, mid - 1)).otherwise(tree(mid, hi))

    nulls = next(k for k, b in enumerate(bounds) if b[0] is None)
    return F.when(F.col("doc_id").isNull(), parts(nulls)).otherwise(tree(0, len(firsts) - 1))


def write(docs: DataFrame, make_encoder: Callable[[], Encoder], dtype: str, folder: str, buckets: int | None = None, ordered: bool = True) -> DataFrame:
    """Encode ``docs(doc_id, text, ...)`` into flat files; returns the manifest, one row per bucket that has rows.

    ``ordered``: documents follow each other by doc_id through all buckets.  Otherwise every input partition is
    a bucket and keeps its order, and no text is shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    store, top = _open(folder)
    store.create_dir(top, recursive=True)

    if ordered:
        if not buckets:
            size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        bounds = _bounds(docs, buckets)
        spread = docs.withColumn("bucket", _bucket(bounds))
        spread = spread.repartitionById(len(bounds), F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    else:
        spread = docs.withColumn("bucket", F.spark_partition_id())

    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, out, bucket = make_encoder(), None, None
        n_docs = n_tokens = 0
        store, top = _open(folder)

        def finish():
            out["idx"].write(np.array([n_tokens], "<u8"))
            for f in out.values():
                f.close()
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "n_docs": n_docs, "n_tokens": n_tokens}], pa.schema([("bucket", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            of = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if bucket != int(of[a]):
                    if out:
                        yield finish()
                    bucket, n_docs, n_tokens = int(of[a]), 0, 0
                    out = {k: _Out(store, f"{top}/{bucket}.{k}") for k in ("bin", "idx", "doc", "nul")}
                part = batch.slice(a, b - a)
                for lo, hi in slices(part.column(1)):
                    flat, counts = encode(part.column(1).slice(lo, hi - lo).to_pylist())
                    ids = part.column(0).slice(lo, hi - lo)
                    out["bin"].write(flat.astype(dtype))
                    out["idx"].write((n_tokens + np.cumsum(counts) - counts).astype("<u8"))
                    out["doc"].write(ids.fill_null(0).to_numpy().astype("<i8"))
                    out["nul"].write((n_docs + np.flatnonzero(ids.is_null())).astype("<u8"))
                    n_docs, n_tokens = n_docs + hi - lo, n_tokens + int(counts.sum())
        if out:
            yield finish()

    rows = spread.mapInArrow(run, MANIFEST).collect()  # one row per bucket
    return spark.createDataFrame(sorted(rows), MANIFEST)


def bases(manifest: DataFrame) -> list[dict]:
    """The manifest's rows in order with ``base`` and ``first_doc``: ids and documents of all buckets before."""
    out, base, first = [], 0, 0
    for r in sorted(manifest.collect()):  # one row per bucket
        out.append(r.asDict() | {"base": base, "first_doc": first})
        base, first = base + r.n_tokens, first + r.n_docs
    return out


def spread_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of one row per bucket, with a task for each row."""
    if not rows:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(*r.values(), i) for i, r in enumerate(rows)], schema + ", task int")
    return table.repartitionById(len(rows), F.col("task")).drop("task")


def null_places(nul: Flat, lo: int, hi: int) -> np.ndarray:
    """Which of the documents lo..hi-1 of a bucket have no doc_id; ``nul`` rises, so its range is found by bisection."""

    def first(value: int) -> int:
        a, b = 0, len(nul)
        while a < b:
            mid = (a + b) // 2
            if int(nul.read(mid, mid + 1)[0]) < value:
                a = mid + 1
            else:
                b = mid
        return a

    out = np.zeros(hi - lo, dtype=bool)
    out[nul.read(first(lo), first(hi)).astype(np.int64) - lo] = True
    return out


def read_documents(spark: SparkSession, manifest: DataFrame, folder: str, dtype: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``ids_crc32`` is the unsigned crc32 of the document's ids as little-endian unsigned 32-bit integers.
    """
    import zlib

    rows = bases(manifest)

    def run(batches):
        store, top = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                flat, offsets, ids, nul = (Flat(store, f"{top}/{r['bucket']}.{k}", t) for k, t in (("bin", dtype), ("idx", "<u8"), ("doc", "<i8"), ("nul", "<u8")))
                for lo in range(0, r["n_docs"], 4096):
                    hi = min(r["n_docs"], lo + 4096)
                    at = offsets.read(lo, hi + 1).astype(np.int64)
                    crc, place = [0] * (hi - lo), 0
                    for begin, block in flat.blocks(int(at[0]), int(at[-1])):  # a document may cross many blocks
                        while place < hi - lo and at[place] < begin + len(block):
                            a, b = max(int(at[place]), begin), min(int(at[place + 1]), begin + len(block))
                            crc[place] = zlib.crc32(block[a - begin : b - begin].astype("<u4"), crc[place])
                            if at[place + 1] > begin + len(block):
                                break
                            place += 1
                    doc = pa.array(ids.read(lo, hi), mask=null_places(nul, lo, hi))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(r["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(np.array(crc, dtype=np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spread_rows(spark, rows, MANIFEST + ", base long, first_doc long")
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
