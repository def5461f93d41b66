"""Watching a folder of sources: new files go through the batch extraction, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.stage import staged
from ..sources import epub, pdf
from ..sources.discovery import checked, file_format


def sources(spark: SparkSession, root: str, max_files: int = 100) -> DataFrame:
    """A stream of (path, document_id, format, content) of EPUB and PDF files that appear below ``root``."""
    rows = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return rows.select("path", X.slug(X.percent_decode(F.col("path"))).alias("document_id"), file_format(F.col("path")).alias("format"), "content").where("format is not null")


_NAMES = "document_id string, path string, batch int"


def owned(batch: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose name is theirs, failures): a name belongs to the path that had it first.

    ``names(document_id, path)``: names of earlier batches, each once.  A name that several new paths of a batch would have
    belongs to none of them.
    """
    inside = batch.groupBy("document_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    asked = inside.join(names.select("document_id", F.col("path").alias("owner")), "document_id", "left")
    asked = asked.withColumn("owner", F.coalesce("owner", F.when(F.size("paths") == 1, F.col("paths")[0])))
    rows = batch.join(asked, "document_id")
    mine = F.coalesce(F.col("path") == F.col("owner"), F.lit(False))
    members = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.concat("paths", F.array("owner"))))), ", ")
    lost = rows.where(~mine).select("document_id", F.lit("name-collision").alias("code"), F.concat(F.lit("Document name collision detected: "), "document_id", F.lit(": "), members).alias("message"))
    return rows.where(mine).select(*batch.columns), lost


def extract_into(stream: DataFrame, output: str, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None):
    """Start a query that writes units, assets, warnings and failures of every micro-batch as Parquet.

    A document whose name an earlier file has, in this micro-batch or any before, is a failure row.  A micro-batch that is run again
    after a failure replaces its own folders and looks only at batches before it, so nothing is written twice.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = staged(checked(batch))
        names = spark.read.schema(_NAMES).parquet(f"{output}/names").where(F.col("batch") < n) if n else spark.createDataFrame([], _NAMES)
        good, lost = owned(rows.where("error is null"), names)
        own = good.select("document_id", "path").join(names.select("document_id"), "document_id", "left_anti")
        own.write.mode("overwrite").parquet(f"{output}/names/batch={n}")
        parts = [reader.extract(good.where(F.col("format") == fmt).select("document_id", "content")) for fmt, reader in (("epub", epub), ("pdf", pdf))]
        both = lambda name: getattr(parts[0], name).unionByName(getattr(parts[1], name), allowMissingColumns=True)
        bad = rows.where("error is not null").select("document_id", "error.code", "error.message")
        units = staged(both("units"))
        for name, found in (("units", units), ("assets", both("assets")), ("warnings", both("warnings")), ("failures", both("failures").unionByName(bad).unionByName(lost))):
            found.write.mode("overwrite").parquet(f"{output}/{name}/batch={n}")
        if also:
            also(units, n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
