"""Batch job: publishes document projects, one partition for each source.

Every source of the documents (Parquet: doc_id, source, lang, text) is a project.  Its documents become numbered units with titles,
file names and neighbours; each project gets a manifest row with its title, main language, writing direction and sizes.

    python -m jobs.publish_units --config jobs/publish_units.json --documents DIR --output DIR

Output: ``units`` (Parquet) and ``manifests`` (JSON), both partitioned by source with dynamic overwrite: a run replaces the projects it
has read and no others, so it can be run again, or for a few ``sources`` only.  Projects that have left the input stay.  On a
cluster the config's ``spark`` settings name a shared folder as ``spark.checkpoint.dir``; the units are kept there while they are written.

Cases: a null or empty source is the project ``unsorted``; null texts are units without text, titled ``Untitled``; units are in
the order of doc_id (null ids first, ties in any order); a null or empty lang is ``und``; an empty table publishes nothing.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, observed
from quire.functions import text as X
from quire.operators import units as U
from quire.operators.stage import staged

log = logging.getLogger("jobs.publish_units")

UNITS = "doc_id long, lang string, pos int, unit_id string, title string, path string, prev_id string, next_id string, n_chars long, text_md5 string, source string"
MANIFESTS = "title string, language string, direction string, n_units long, n_distinct long, n_chars long, source string"


@dataclass(frozen=True)
class Config:
    """``sources``: the projects to publish (null: all)."""

    sources: list[str] | None = None


def published_units(docs: DataFrame) -> DataFrame:
    """Units of all projects; no text is left when they are sorted."""
    named = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other)).alias(c)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", named("lang", "und"), X.derive_title(F.col("text")).alias("title"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"), named("source", "unsorted"))
    units = U.numbered(rows, "source", "doc_id", neighbours=True)
    return units.select("doc_id", "lang", "pos", "unit_id", "title", X.unit_path(F.col("pos"), F.col("title")).alias("path"), "prev_id", "next_id", "n_chars", "text_md5", "source")


def manifests(units: DataFrame) -> DataFrame:
    """One row for each project; counts of languages and of distinct texts are added up in two steps, so no project is one group of rows."""
    by_lang = units.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang"))["lang"].alias("language"))
    by_text = units.groupBy("source", "text_md5").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min(F.struct("pos", "title")).alias("first"))
    sums = by_text.groupBy("source").agg(F.min("first")["title"].alias("title"), F.sum("n").alias("n_units"), F.count("*").alias("n_distinct"), F.sum("chars").alias("n_chars"))
    return sums.join(by_lang, "source").select("title", "language", X.direction(F.col("language")).alias("direction"), "n_units", "n_distinct", "n_chars", "source")


def read_units(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(UNITS).parquet(f"{output}/units")


def read_manifests(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(MANIFESTS).json(f"{output}/manifests")


def run(spark: SparkSession, documents: str, output: str, config: Config = Config()) -> dict:
    """Publish the projects of ``documents``; -> what was read and written."""
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    if config.sources is not None:
        docs = docs.where(F.coalesce(F.nullif("source", F.lit("")), F.lit("unsorted")).isin(list(config.sources)))
    # both outputs come from one table, so a manifest fits its units
    units = staged(published_units(docs))
    by_source = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source")
    # observed behind the ranges, for their bounds are sampled by a pass of its own
    rows, wrote = observed(units.repartitionByRange("source", "pos"), chars=F.coalesce(F.sum("n_chars"), F.lit(0)))
    by_source(rows).parquet(f"{output}/units")
    made, listed = observed(manifests(units).repartitionByRange("source"))
    by_source(made).json(f"{output}/manifests")
    done = {"units": wrote.get["rows"], "chars": wrote.get["chars"], "projects": listed.get["rows"]}
    log.info("read %d documents of %d characters from %s", done["units"], done["chars"], documents)
    log.info("wrote %d units and %d manifests below %s", done["units"], done["projects"], output)
    return done


if __name__ == "__main__":
    command_line("publish_units", Config, ("documents", "output"), run)
