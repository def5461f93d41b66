"""Finding source files and reading their bytes, with failures kept per row."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, row_error
from ..functions import text as X
from ..operators.links import collisions
from ..operators.stage import staged

FORMATS = ("epub", "pdf")


def file_format(path):
    """``epub`` or ``pdf`` by the suffix, in any case, else null."""
    return F.when(F.lower(path).endswith(".epub"), "epub").when(F.lower(path).endswith(".pdf"), "pdf")


def signature_ok(fmt, content):
    """The first bytes fit the format: ``PK`` or ``%PDF-``."""
    return ((fmt == "epub") & (F.hex(F.substring(content, 1, 2)) == "504B")) | ((fmt == "pdf") & (F.hex(F.substring(content, 1, 5)) == "255044462D"))


_ENTRIES = "path string, relative_path string, kind string, size long"


def _listed(folders: list[tuple[str, str]]) -> list[tuple[str, str, str, int | None]]:
    """Entries of folders (path, relative path): kind is folder, file, other or, for a folder that cannot be read, unreadable."""
    out = []
    for path, relative in folders:
        try:
            with os.scandir(path) as entries:
                for e in entries:
                    kind = "folder" if e.is_dir(follow_symlinks=False) else "file" if e.is_file(follow_symlinks=False) else "other"
                    out.append((e.path, f"{relative}/{e.name}" if relative else e.name, kind, e.stat(follow_symlinks=False).st_size if kind == "file" else None))
        except OSError:
            out.append((path, relative, "unreadable", None))
    return out


def _entries(spark: SparkSession, root: str) -> DataFrame:
    """All that lies below a folder, level by level: the folders of a level are rows, and tasks list them.

    Names that begin with a dot or an underscore are entries like others; symbolic links are not followed.
    """

    def run(frames):
        for frame in frames:
            yield pd.DataFrame(_listed(list(zip(frame["path"], frame["relative_path"]))), columns=["path", "relative_path", "kind", "size"]).astype({"size": "Int64"})

    level, found = spark.createDataFrame([(root, "")], "path string, relative_path string"), None
    while True:
        below = staged(level.repartition(F.col("path")).mapInPandas(run, _ENTRIES))
        found = below if found is None else found.unionByName(below)
        level = below.where("kind = 'folder'").select("path", "relative_path")
        if level.isEmpty():
            return found.where("kind <> 'folder'")


def _local(root: str) -> str | None:
    """The path of a root that driver and tasks reach as files, else null."""
    if root.startswith("file:"):
        return "/" + root.removeprefix("file:").lstrip("/")
    return None if re.match("[a-z][a-z0-9+.-]*:", root) else os.path.abspath(root)


def _sorted(df: DataFrame) -> DataFrame:
    """By path in the order of the root locale: case and accents decide last."""
    return df.orderBy(F.collate("relative_path", "UNICODE"), "relative_path")


def discover(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Sources (path, relative_path, format, document_name, size) and skipped paths below ``root``, both in locale order.

    Skipped are files of other formats, special files, links and folders that cannot be read; a root that cannot be read is an error.
    Only the listing is read here.  A root in a store that only Spark reads is listed by Spark, which passes over hidden names.
    """
    local = _local(root)
    if local is None:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        except Exception as error:
            raise EngineError("validation-error", f"Unable to read sources/: {error}") from error
        base = "/" + root.split("://")[-1].strip("/") + "/"
        relative = X.percent_decode(F.regexp_extract("path", "^.*?" + re.escape(base) + "(.*)$", 1))
        found = files.select("path", relative.alias("relative_path"), F.lit("file").alias("kind"), F.col("length").alias("size"))
    elif os.path.isfile(local):
        found = spark.createDataFrame([(local, os.path.basename(local), "file", os.path.getsize(local))], _ENTRIES)
    else:
        try:
            os.scandir(local).close()
        except OSError as error:
            raise EngineError("validation-error", f"Unable to read sources/: {error}") from error
        found = _entries(spark, local)
    found = found.withColumn("format", F.when(F.col("kind") == "file", file_format(F.col("relative_path"))))
    sources = found.where("format is not null").withColumn("document_name", X.slug(F.col("relative_path")))
    return _sorted(sources.select("path", "relative_path", "format", "size", "document_name")), _sorted(found.where("format is null").select("relative_path"))


def contents(spark: SparkSession, root: str, sources: DataFrame, head: int | None = None) -> DataFrame:
    """``sources`` with ``content``, or its first ``head`` bytes; a file that has gone or cannot be read has none."""
    if _local(root) is None:
        content = F.col("content") if head is None else F.substring("content", 1, head).alias("content")
        return sources.join(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", content), "path", "left")
    names = [*sources.columns, "content"]

    def run(frames):
        for frame in frames:
            for i in range(len(frame)):  # one file at a time
                one = frame.iloc[[i]].copy()
                try:
                    with open(one["path"].iloc[0], "rb") as f:
                        one["content"] = [f.read(-1 if head is None else head)]
                except OSError:
                    one["content"] = [None]
                yield one[names]

    schema = T.StructType([*sources.schema.fields, T.StructField("content", T.BinaryType())])
    return sources.mapInPandas(run, schema)


def check_collisions(sources: DataFrame) -> None:
    """Raise before any work when two sources would have the same document name."""
    found = collisions(sources, "document_name", member="relative_path").collect()  # rows are errors, and stop the run
    if found:
        detail = "; ".join(f"{r.document_name}: {r.members}" for r in sorted(found, key=lambda r: r.document_name))
        raise EngineError("name-collision", f"Document name collision detected: {detail}")


def checked(rows: DataFrame) -> DataFrame:
    """``rows(format, path, content)`` with ``error`` for formats and signatures that do not fit."""
    bad = F.when(F.col("format").isNull(), row_error("unsupported-structure", F.concat(F.lit("Unsupported source: "), F.col("path"))))
    bad = bad.when(F.col("content").isNull(), row_error("malformed-source", F.concat(F.lit("Unable to read the file: "), F.col("path"))))
    bad = bad.when(~signature_ok(F.col("format"), F.col("content")), row_error("malformed-source", F.concat(F.lit("File signature does not match: "), F.col("path"))))
    return rows.withColumn("error", bad)
