"""Stored answers of benchmark runs: one table, partitioned by model, of which a run replaces its own models only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

ANSWERS = "unit_id string, unit_title string, path string, markdown string, chars long, duration_ms long, cost_usd double, ok boolean, error string, model string"
#: Where answers are shown as files, seen from the report.
FOLDER = "benchmark-output"
_COLUMNS = [c.split()[0] for c in ANSWERS.split(", ")]


def stored_path(folder: str):
    """Where a model's answer for the unit at ``unit_path`` is shown, seen from the report: folder, model, file name."""
    name = F.element_at(F.split(F.replace("unit_path", F.lit("\\"), F.lit("/")), "/"), -1)
    return F.concat_ws("/", F.lit(folder.strip("/")), "model", name)


def of_results(results: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Answer rows of a run's results (unit_id, unit_title, unit_path, model, status, markdown, ...)."""
    return results.select(
        "unit_id", "unit_title", stored_path(folder).alias("path"), "markdown", F.length("markdown").cast("long").alias("chars"), F.col("duration_ms").cast("long").alias("duration_ms"), "cost_usd",
        (F.col("status") == "translated").alias("ok"), "error", "model",
    )


def store(rows: DataFrame, path: str) -> None:
    """Write answers; partitions of other models stay, and a run that is repeated gives the same table.

    A model's rows are dealt over files by ranges, so one model with most of the rows is no single task.
    """
    rows.select(*_COLUMNS).repartitionByRange("model", "path").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWERS).parquet(path)


def reviewed(rows: DataFrame, links: bool = True) -> DataFrame:
    """(model, listed): for each model a Markdown list of its answers for a reader, with links to the stored files."""
    name = F.concat(F.lit("["), X.escape_markdown(F.col("unit_title")), F.lit("]("), F.col("path"), F.lit(")")) if links else X.escape_markdown(F.col("unit_title"))
    line = F.concat(F.lit("- "), name, F.when(F.col("ok"), "").otherwise(F.concat(F.lit(": "), F.coalesce("error", F.lit("failed")))))
    return rows.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", line.alias("t")))), lambda x: x["t"]), "\n").alias("listed"))
