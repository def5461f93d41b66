"""The cache of translated texts as segments: every run appends its own keys and rewrites nothing.

The table is partitioned by ``segment``, a number that rises with the runs; of equal keys the row of the highest segment holds.  A
segment that is written again after a failure replaces itself (dynamic overwrite).  ``compact`` writes the rows that hold into one
segment beside the table and swaps it in.  One run writes a table at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import project

SEGMENTS = schemas.CACHE + ", segment long"
_COLUMNS = ("key", "unit_id", "markdown", "translated_title", "usage", "cost_usd", "duration_ms", "model")


def _layout(spark: SparkSession, path: str) -> str | None:
    """``segments``, ``plain`` (a table without segments) or None for a table that is missing or cannot be read."""
    try:
        found = spark.read.parquet(path)
        found.select(*_COLUMNS)
    except Exception:
        return None
    return "segments" if "segment" in found.columns else "plain"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all segments; a table without segments is segment 0, one that cannot be read is empty."""
    layout = _layout(spark, path)
    if layout is None:
        return spark.createDataFrame([], SEGMENTS)
    if layout == "plain":
        return spark.read.parquet(path).select(*_COLUMNS, F.lit(0).cast("long").alias("segment"))
    return spark.read.schema(SEGMENTS).parquet(path)


def newest(segments: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """One row for each key, of its highest segment; with ``keys(key)``, of those keys only, cut before rows of a key meet."""
    rows = segments if keys is None else segments.join(keys.select("key").distinct(), "key", "left_semi")
    rest = [c for c in segments.columns if c not in ("key", "segment")]
    best = rows.groupBy("key").agg(F.max(F.struct("segment", *rest)).alias("x"))
    return best.select("key", *[F.col(f"x.{c}").alias(c) for c in segments.columns if c != "key"])


def append(new: DataFrame, path: str, segment: int | None = None) -> int:
    """Write ``new`` as a segment, the next one by default; its number."""
    spark = new.sparkSession
    if _layout(spark, path) == "plain":
        _replace(read(spark, path), path)
    if segment is None:
        # only the folders' names are read for it
        top = read(spark, path).agg(F.max("segment")).first()[0]
        segment = 0 if top is None else top + 1
    rows = new.select(*_COLUMNS, F.lit(segment).cast("long").alias("segment"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(path)
    return segment


def _replace(rows: DataFrame, path: str) -> None:
    project.swap_table(rows, path, "segment")


def compact(spark: SparkSession, path: str) -> int:
    """Leave one segment with the rows that hold; -> the rows that went."""
    rows = read(spark, path)
    kept, before = newest(rows), rows.count()
    _replace(kept.select(*_COLUMNS, "segment").withColumn("segment", F.lit(0).cast("long")), path)
    return before - read(spark, path).count()
