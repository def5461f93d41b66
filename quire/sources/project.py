"""Document projects on a file system: manifest, chapters, assets, templates and reports; written beside and swapped in."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import EngineError, ValidationError
from ..operators import manifest as M
from ..operators import render as R


def load_manifests(spark: SparkSession, *project_dirs: str) -> DataFrame:
    """(document_id, manifest) of projects; unknown fields are dropped, broken files and rules raise."""
    paths = [os.path.join(p, "manifest.json") for p in project_dirs]
    for p in paths:
        if "://" not in p and not os.path.exists(p):
            raise EngineError("document-not-found", f"Document was not found: {os.path.dirname(p)}")
    try:
        rows = spark.read.schema(schemas.schema(schemas.MANIFEST)).option("multiLine", True).option("mode", "FAILFAST").json(paths)
        rows = rows.select(F.col("id").alias("document_id"), F.struct("*").alias("manifest"))
        broken = M.violations(rows).orderBy("document_id", "rule_no").limit(1).collect()
    except EngineError:
        raise
    except Exception as error:
        raise EngineError("malformed-source", f"Unable to read the manifest: {error}") from error
    if broken:
        raise ValidationError(broken[0].message)
    return rows


def load_units(spark: SparkSession, project_dir: str, only: list[int] | None = None) -> DataFrame:
    """Units of one project with their texts; ordinals are chosen before any chapter file is read."""
    rows = load_manifests(spark, project_dir).select("document_id", F.posexplode("manifest.units").alias("n", "u"))
    rows = rows.select("document_id", (F.col("n") + 1).alias("pos"), F.col("u.id").alias("unit_id"), F.col("u.title").alias("title"), F.col("u.path").alias("path"), F.col("u.source").cast(schemas.LOCATION).alias("source"))
    if only is not None:
        rows = rows.where(F.col("pos").isin(sorted(set(only))))
    wanted = [r.path for r in rows.select("path").collect()]  # the units of one document
    for p in wanted:
        inside(project_dir, p)
        if not os.path.exists(os.path.join(project_dir, p)):
            raise EngineError("unit-not-found", f"Unit file was not found: {p}")
    texts = spark.read.text([os.path.join(project_dir, p) for p in wanted], wholetext=True).select(F.col("value").alias("markdown"), F.regexp_extract(F.col("_metadata.file_path"), "(chapters/[^/]*)$", 1).alias("path"))
    return rows.join(texts, "path").select("document_id", "pos", "unit_id", "title", "path", "source", "markdown")


def inside(root: str, path: str) -> str:
    """The real path of ``path`` in ``root``; links and paths that leave it are refused."""
    full = os.path.join(root, path)
    real, top = os.path.realpath(full), os.path.realpath(root)
    if real != top and not real.startswith(top + os.sep):
        raise ValidationError(f"Path must stay inside the document directory: {path}")
    if os.path.islink(full):
        raise ValidationError(f"Symbolic links are not supported: {path}")
    return full


def swap(staged: str, target: str, backup: str | None = None) -> None:
    """Rename the folder ``staged`` to ``target``; what was there goes (by way of ``backup``), or comes back if that fails."""
    backup = backup or f"{target}.old-{uuid.uuid4().hex}"
    moved = os.path.exists(target)
    if moved:
        os.rename(target, backup)
    try:
        os.rename(staged, target)
    except OSError:
        if moved:
            os.rename(backup, target)
        raise
    if moved:
        shutil.rmtree(backup, ignore_errors=True)


def swap_in(target: str, force: bool, fill: Callable[[str], None]) -> None:
    """Fill a folder beside ``target`` and rename it into place; what was there comes back if that fails."""
    if os.path.isdir(target) and os.listdir(target) and not force:
        raise ValidationError(f"Output {target} already has content. Use force to replace it.")
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    staged = f"{target}.tmp-{uuid.uuid4().hex}"
    try:
        os.makedirs(staged)
        fill(staged)
        swap(staged, target)
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def _put(path: str, data: str | bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)


def write_project(target: str, document: str, manifest: DataFrame, units: DataFrame, assets: DataFrame, reports: dict[str, str] | None = None, force: bool = False, templates: dict[str, bytes] | None = None) -> dict:
    """One project's files.  Chapters and assets come to the driver row by row, one at a time.

    ``templates`` take the place of the default ones.  Returns counts of units and images.
    """
    of = lambda df: df.where(F.col("document_id") == document)

    def clean(x):
        return {k: clean(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, list) else int(x) if isinstance(x, float) and x.is_integer() else x

    counts = {"units": 0, "images": 0}

    def fill(folder: str) -> None:
        (row,) = of(manifest).collect()
        _put(f"{folder}/manifest.json", json.dumps(clean(row.manifest.asDict(True)), indent=2, ensure_ascii=False) + "\n")
        for u in of(units).select("path", "markdown").toLocalIterator():
            _put(inside(folder, u.path), u.markdown)
            counts["units"] += 1
        for a in of(assets).select("path", "bytes").toLocalIterator():
            if not a.path.startswith("assets/"):
                raise ValidationError(f"Asset path must be under assets/: {a.path}")
            _put(inside(folder, a.path), bytes(a.bytes))
            counts["images"] += 1
        for name, text in ({"base.html": R.BASE, "print.css": R.STYLES} | (templates or {})).items():
            _put(f"{folder}/templates/{name}", text)
        for name, text in (reports or {}).items():
            _put(f"{folder}/reports/{name}", text)

    swap_in(target, force, fill)
    return counts


def write_library(path: str, units: DataFrame, assets: DataFrame, warnings: DataFrame) -> None:
    """Many projects as Parquet, a folder per document: the form for collections that no single machine holds."""
    for name, df in (("units", units), ("assets", assets), ("warnings", warnings)):
        df.write.mode("errorifexists").partitionBy("document_id").parquet(f"{path.rstrip('/')}/{name}")


def _store(spark: SparkSession, path):
    """Spark's file system of a Hadoop path."""
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def swap_table(rows: DataFrame, path: str, *partition: str) -> None:
    """Replace a table by one written beside it, by renames: a failure leaves the old table under its name or beside it."""
    spark, path = rows.sparkSession, path.rstrip("/")
    tag = uuid.uuid4().hex
    new, old = f"{path}.tmp-{tag}", f"{path}.old-{tag}"
    rows.write.partitionBy(*partition).parquet(new)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = _store(spark, at(path))
    had = store.exists(at(path))
    if had and not store.rename(at(path), at(old)):
        raise EngineError("write-failed", f"Unable to move the table: {path}")
    if not store.rename(at(new), at(path)):
        if had:
            store.rename(at(old), at(path))
        raise EngineError("write-failed", f"Unable to replace the table: {path}")
    if had:
        store.delete(at(old), True)
