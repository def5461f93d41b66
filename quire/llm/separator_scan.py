"""Token counts by a separator scan over flat, unindexed token files.

A file is cut into blocks of a fixed number of ids.  Each block is searched on its own, at once, for the end
identifier; it yields the lengths of the documents that end inside it, where the first one counts only the ids of
this block.  Prefix sums over the blocks' separators and their open tails then give every document its number in
the corpus and add the ids that earlier blocks hold of it, however many blocks a document crosses.

Cases: no end identifier in a block: all its ids are an open tail.  Ids after the last separator of a file are a
document without an end (``complete`` false).  A file of separators only: documents of length 0.  Empty file: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .flat_tokens import Flat, _open, bases, null_places, spread_rows
from .store import written

#: Ids of a block; the block table has one row per block.
BLOCK_IDS = 1 << 22
STEP = 1 << 18


def scan(spark: SparkSession, files: list[dict], folder: str, dtype: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``files``: {bucket, n_tokens} in corpus order -> (bucket, doc_no, n_tokens, complete).

    ``doc_no`` counts the documents of a file from 0; ``n_tokens`` leaves the end identifier out.
    """
    table = spark.createDataFrame([(f["bucket"], f["n_tokens"]) for f in files], "of int, n_tokens long").where("n_tokens > 0")
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / block_ids).cast("int")))
    tasks = table.select("of", "n_tokens", block.alias("block"))
    tasks = tasks.select("of", "block", (F.col("block").cast("long") * block_ids).alias("lo"), F.least("n_tokens", (F.col("block") + 1).cast("long") * block_ids).alias("hi"))
    tasks = tasks.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "of", "block")

    def run(batches):
        store, top = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                flat = Flat(store, f"{top}/{r['of']}.bin", dtype)
                # one row per separator, numbered inside the block; the last row (null) is the open tail
                last = k = 0
                for lo, part in flat.blocks(r["lo"], r["hi"], STEP):
                    at = np.flatnonzero(part == end_id) + (lo - r["lo"])
                    n = len(at)
                    if n:
                        size = np.diff(at, prepend=last - 1) - 1
                        last = int(at[-1]) + 1
                        k += n
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["of"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), pa.array(np.arange(k - n, k, dtype=np.int64)), pa.array(size.astype(np.int64))], ["bucket", "block", "k", "size"])
                tail = r["hi"] - r["lo"] - last
                yield pa.RecordBatch.from_arrays([pa.array([r["of"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([None], pa.int64()), pa.array([tail], pa.int64())], ["bucket", "block", "k", "size"])

    found = written(tasks.mapInArrow(run, "bucket int, block int, k long, size long"))
    # one row per block: its separators, its open tail, and the sums over the file's blocks before it
    per_block = found.groupBy("bucket", "block").agg(F.count("k").alias("ends"), F.max(F.when(F.col("k").isNull(), F.col("size"))).alias("tail"))
    order = W.partitionBy("bucket").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per_block = per_block.withColumn("doc0", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # ids that came before this block and belong to the document open at its start
    per_block = per_block.withColumn("run", F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("block"))).over(before), F.lit(-1)))
    per_block = per_block.withColumn("carried", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    behind = per_block.select("bucket", F.col("block").alias("run"), (F.col("carried")).alias("skip"))
    per_block = per_block.join(behind, ["bucket", "run"], "left").withColumn("carry", F.col("carried") - F.coalesce("skip", F.lit(0)))
    last = per_block.groupBy("bucket").agg(F.max("block").alias("last"))
    per_block = per_block.join(last, "bucket").select("bucket", "block", "doc0", "carry", "ends", "last")
    rows = found.join(per_block, ["bucket", "block"])
    ended = rows.where("k is not null").select("bucket", (F.col("doc0") + F.col("k")).alias("doc_no"), (F.col("size") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("complete"))
    left = rows.where("k is null and block = last").withColumn("n_tokens", F.col("size") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(0)).where("n_tokens > 0")
    left = left.select("bucket", (F.col("doc0") + F.col("ends")).alias("doc_no"), "n_tokens", F.lit(False).alias("complete"))
    return ended.unionByName(left)


def token_counts(spark: SparkSession, manifest: DataFrame, folder: str, dtype: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_tokens) of the documents of flat files: counts come from the scan, ids from the doc files."""
    files = bases(manifest)
    counts = scan(spark, files, folder, dtype, end_id, block_ids)

    def run(batches):
        store, top = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                ids, nul = (Flat(store, f"{top}/{r['bucket']}.{k}", t) for k, t in (("doc", "<i8"), ("nul", "<u8")))
                for lo in range(0, len(ids), STEP):
                    part = ids.read(lo, lo + STEP)
                    n = len(part)
                    doc = pa.array(part, mask=null_places(nul, lo, lo + n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["bucket"], np.int32)), pa.array(np.arange(lo, lo + n, dtype=np.int64)), doc], ["bucket", "doc_no", "doc_id"])

    names = spread_rows(spark, [{"bucket": f["bucket"]} for f in files], "bucket int").mapInArrow(run, "bucket int, doc_no long, doc_id long")
    return names.join(counts, ["bucket", "doc_no"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
