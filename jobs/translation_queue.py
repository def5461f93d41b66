"""Incremental job: the queue of texts that still have to be translated.

Watches a folder of documents (Parquet: doc_id, text, lang; or a glob of files) as a file stream.  A run takes the files that have come since the last
one, gives every text its content key (model, language, prompt version, text), leaves out the keys that earlier batches have
queued or that the translation cache already has, and writes what is left: one row for each key with its title, estimated tokens
and cost.  So no text is paid for twice, however often it comes.

    python -m jobs.translation_queue --config jobs/translation_queue.json --documents DIR --output DIR --checkpoint DIR

Output: Parquet, partitioned by batch and lang.  The stream's checkpoint is the mark; it belongs to the output.  A batch that is run
again after a failure replaces its own partitions (dynamic overwrite) and reads only batches before it, so it gives the same rows;
a run without new files writes nothing.

Cases: null texts and texts of white space are not queued; a null or empty lang is ``und``; of equal texts in a batch the row with
the smallest doc_id stands for all (null ids last, then lang), ``n_docs`` is their number.  An empty folder is a run without new files.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, observed
from quire.errors import ValidationError
from quire.functions import text as X
from quire.operators import models, translate

log = logging.getLogger("jobs.translation_queue")

DOCUMENTS = "doc_id long, text string, lang string"
QUEUE = "key string, doc_id long, title string, n_docs long, input_tokens long, output_tokens long, cost_usd double, batch int, lang string"


@dataclass(frozen=True)
class Config:
    """``max_files``: files of a micro-batch (null: all that are new); ``cache``: path of a table of translated keys."""

    model: str = models.DEFAULT_MODEL
    to: str = "fr"
    max_files: int | None = None
    cache: str | None = None

    def __post_init__(self) -> None:
        models.find(self.model)
        object.__setattr__(self, "to", translate.language_tag(self.to))
        if self.max_files is not None and self.max_files < 1:
            raise ValidationError("max_files is null or at least 1")


def queue_rows(docs: DataFrame, config: Config) -> DataFrame:
    """One row for each distinct text of ``docs``; texts themselves are left behind before any shuffle."""
    m = models.find(config.model)
    jobs = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.coalesce(F.nullif("lang", F.lit("")), F.lit("und")).alias("lang"), F.col("text").alias("markdown"))
    jobs = translate.keyed(jobs, config.model, config.to).withColumn("title", X.derive_title(F.col("markdown")))
    jobs = jobs.select("key", "doc_id", "lang", "title", translate.tokens_in(F.col("markdown"), F.col("title")).alias("input_tokens"), translate.tokens_out(F.col("markdown")).alias("output_tokens"))
    # equal keys have equal texts, so equal titles and tokens
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "lang")).alias("first")
    rows = jobs.groupBy("key").agg(first, F.count("*").alias("n_docs"), *[F.first(c).alias(c) for c in ("title", "input_tokens", "output_tokens")])
    cost = X.estimate_cost(F.col("input_tokens"), F.lit(0), F.col("output_tokens"), F.lit(m["price_in"]), F.lit(m["price_cached"]), F.lit(m["price_out"]))
    return rows.select("key", "first.doc_id", "title", "n_docs", "input_tokens", "output_tokens", cost.alias("cost_usd"), "first.lang")


def read_queue(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(QUEUE).parquet(output)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: Config = Config()) -> dict:
    """Queue the texts of the files that are new below ``documents``; -> what was read and written."""
    done = {"batches": 0, "documents": 0, "queued": 0, "cost_usd": 0.0}

    def each(batch: DataFrame, n: int) -> None:
        docs, read = observed(batch)
        rows = queue_rows(docs, config)
        if config.cache:
            rows = translate.cache_misses(rows, spark.read.parquet(config.cache))
        if n:
            rows = translate.cache_misses(rows, read_queue(spark, output).where(F.col("batch") < n))
        # ranges of (lang, key): a frequent language has many files, a rare one a single file
        rows = rows.withColumn("batch", F.lit(n).cast("int")).repartitionByRange("lang", "key")
        # observed behind the ranges, for their bounds are sampled by a pass of its own
        rows, wrote = observed(rows, cost=F.coalesce(F.sum("cost_usd"), F.lit(0.0)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(output)
        log.info("batch %d: read %d documents from %s, queued %d texts of %.6f USD into %s", n, read.get["rows"], documents, wrote.get["rows"], wrote.get["cost"], output)
        done["batches"] += 1
        done["documents"] += read.get["rows"]
        done["queued"] += wrote.get["rows"]
        done["cost_usd"] = round(done["cost_usd"] + wrote.get["cost"], 6)

    reader = spark.readStream.schema(DOCUMENTS)
    if config.max_files:
        reader = reader.option("maxFilesPerTrigger", config.max_files)
    query = reader.parquet(documents).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("run: %d batches, %d documents read, %d texts queued, %.6f USD", done["batches"], done["documents"], done["queued"], done["cost_usd"])
    return done


if __name__ == "__main__":
    command_line("translation_queue", Config, ("documents", "output", "checkpoint"), run)
