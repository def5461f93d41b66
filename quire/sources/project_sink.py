"""Project folders written by tasks: a sink for rows (document_id, path, content).

Every task writes its files into a staging folder of the library, under a name of its own and renamed when whole, so a task that is
lost or runs twice does no harm.  Projects lie there in ``BUCKETS`` folders by a hash of their names.  When all are written, tasks take
the buckets and rename each project's folder into its place, the old one out of the way first; a project is at any time whole, the old
or the new, and a bucket that is taken again goes on where it was left.  If a write fails for good, the abort deletes the staging
folder and no project is touched.  The library is a folder that driver and tasks share.

``read_projects`` is the way back: tasks list the projects and read their files, and no names pass through the driver.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..errors import ValidationError
from ..operators import render as R
from .project import swap

NAME = "quire_projects"
FILES = "document_id string, path string, content binary"
#: Tasks that put projects into their places, and that list and read them at least.
_TASKS = 64
#: Folders of a library that are the sink's own, and no projects.
_OWN = re.compile(r"\.(tmp|old)-[0-9a-f]{32}")
#: Rows and bytes of names or contents that a task reads at once; a file that is larger comes alone.
_ROWS, _BYTES = 4096, 4 << 20


BUCKETS = tuple(f"{i:02x}" for i in range(256))
_OLD = "old"
#: A task remembers so many folders that it has made or found.
_KNOWN = 1 << 16


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    """Made once, on the driver; tasks, commit and abort work on copies of it.  With ``staging`` the commit leaves the projects there."""

    def __init__(self, library: str, staging: str | None = None) -> None:
        self.library, self.later = library, staging is not None
        self.staging = staging or os.path.join(library, f".tmp-{uuid.uuid4().hex}")
        self.tag = os.path.basename(self.staging).removeprefix(".tmp-")
        os.mkdir(self.staging)

    def _folder(self, document: str, parts: list[str]) -> str:
        """The folder of a file, made if need be; never the staging folder itself, which an abort has taken away."""
        at = self.staging
        for part in (BUCKETS[zlib.crc32(document.encode()) % len(BUCKETS)], document, *parts):
            at = os.path.join(at, part)
            with contextlib.suppress(FileExistsError):
                os.mkdir(at)
        return at

    def write(self, iterator: Iterator) -> _Written:
        n, known, own = 0, {}, f"{self.tag}-{TaskContext.get().taskAttemptId()}"
        for document, path, content in iterator:
            if os.path.basename(document) != document or document in ("", ".", ".."):
                raise ValidationError(f"Invalid document name: {document}")
            *parts, name = os.path.normpath(path).split(os.sep)
            if os.path.isabs(path) or name in (".", "..") or parts[:1] == [".."]:  # the folder is new, so no link leads out of it
                raise ValidationError(f"Path must stay inside the document directory: {path}")
            at = (document, *parts)
            if at not in known:
                if len(known) >= _KNOWN:
                    known.clear()
                known[at] = self._folder(document, parts)
            full = f"{known[at]}/{name}"
            with open(f"{full}.{own}", "wb", buffering=0) as f:
                rest = memoryview(content)
                while len(rest):
                    rest = rest[f.write(rest) :]
            os.rename(f"{full}.{own}", full)
            n += 1
        return _Written(n)

    def commit(self, messages: list) -> None:
        if not self.later:
            for bucket in BUCKETS:
                settle(self.library, self.staging, bucket)
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        # tasks may still be running: renamed, the folder is gone for them at once
        gone = os.path.join(self.library, f".old-{self.tag}")
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.staging, gone)
        shutil.rmtree(gone, ignore_errors=True)


def _clear(folder: str, mark: str) -> None:
    """Delete the files of attempts that were lost."""
    with os.scandir(folder) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                _clear(e.path, mark)
            elif mark in e.name:
                os.remove(e.path)


def settle(library: str, staging: str, bucket: str) -> int:
    """Put the projects of a bucket into their places; -> how many.  Another attempt finds only those that are left."""
    folder, n = os.path.join(staging, bucket), 0
    if not os.path.isdir(folder):
        return n
    old = os.path.join(staging, _OLD, bucket)
    os.makedirs(old, exist_ok=True)
    mark = "." + os.path.basename(staging).removeprefix(".tmp-") + "-"
    for document in os.listdir(folder):
        at = os.path.join(folder, document)
        try:
            _clear(at, mark)
            swap(at, os.path.join(library, document), os.path.join(old, f"{document}-{uuid.uuid4().hex}"))
        except FileNotFoundError:
            if os.path.exists(at):
                raise
            continue  # another attempt has put it there
        n += 1
    return n


def _undo(library: str, staging: str) -> None:
    """Projects whose new folder never came are named as before; the staging folder goes."""
    for top, names, _ in os.walk(os.path.join(staging, _OLD)):
        if os.path.basename(top) != _OLD:
            for name in names:
                target = os.path.join(library, name[:-33])
                if not os.path.exists(target):
                    os.rename(os.path.join(top, name), target)
            names.clear()
    shutil.rmtree(staging, ignore_errors=True)


class ProjectFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FILES

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(os.path.abspath(self.options["path"]), self.options.get("staging"))


@F.pandas_udf(T.StringType())
def _pretty(manifests: pd.Series) -> pd.Series:
    """Manifest JSON in the layout of project folders; whole numbers lose their point."""

    def clean(x):
        return {k: clean(v) for k, v in x.items()} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, list) else int(x) if isinstance(x, float) and x.is_integer() else x

    return manifests.map(lambda m: json.dumps(clean(json.loads(m)), indent=2, ensure_ascii=False) + "\n")


def project_files(manifests: DataFrame, units: DataFrame, assets: DataFrame, reports: DataFrame | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """All files of projects as rows: manifest, chapters, assets, templates and ``reports(document_id, name, text)``."""
    row = lambda path, content: ("document_id", path.alias("path"), content.cast("binary").alias("content"))
    styles = {"base.html": R.BASE, "print.css": R.STYLES} | (templates or {})
    each = F.explode(F.array(*[F.struct(F.lit(f"templates/{name}").alias("path"), F.lit(text).alias("text")) for name, text in styles.items()]))
    out = manifests.select(*row(F.lit("manifest.json"), _pretty(F.to_json("manifest"))))
    out = out.unionByName(units.select(*row(F.col("path"), F.coalesce("markdown", F.lit("")))))
    bad = F.raise_error(F.concat(F.lit("Asset path must be under assets/: "), F.col("path"))).cast("string")
    out = out.unionByName(assets.select(*row(F.when(F.col("path").startswith("assets/"), F.col("path")).otherwise(bad), F.col("bytes"))))
    out = out.unionByName(manifests.select("document_id", each.alias("t")).select(*row(F.col("t.path"), F.col("t.text"))))
    if reports is not None:
        out = out.unionByName(reports.select(*row(F.concat(F.lit("reports/"), F.col("name")), F.col("text"))))
    return out


def write_projects(files: DataFrame, library: str, force: bool = False) -> None:
    """Write projects from tasks; without ``force`` a project that has content already refuses all of them."""
    spark: SparkSession = files.sparkSession

    @F.pandas_udf(T.BooleanType())
    def taken(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: os.path.isdir(os.path.join(library, d)) and bool(os.listdir(os.path.join(library, d)))).astype(bool)

    if not force:
        full = files.where("path = 'manifest.json'").select("document_id").where(taken("document_id")).first()
        if full is not None:
            raise ValidationError(f"Output {os.path.join(library, full.document_id)} already has content. Use force to replace it.")
    os.makedirs(library, exist_ok=True)
    spark.dataSource.register(ProjectFiles)
    library = os.path.abspath(library)
    staging = os.path.join(library, f".tmp-{uuid.uuid4().hex}")

    @F.pandas_udf(T.LongType())
    def settled(buckets: pd.Series) -> pd.Series:
        return buckets.map(lambda b: settle(library, staging, BUCKETS[b])).astype("int64")

    try:
        files.select("document_id", "path", "content").write.format(NAME).option("staging", staging).mode("append").save(library)
        spark.range(0, len(BUCKETS), 1, _TASKS).select(settled("id").alias("n")).agg(F.sum("n")).collect()
    finally:
        _undo(library, staging)


def _batches(rows: Iterable[tuple], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of texts, or with bytes in the last column, in batches of bounded size."""
    kinds = [pa.binary() if name == "content" else pa.string() for name in names]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held), kinds)], list(names))

    for row in rows:
        if held and (len(held) >= _ROWS or size + len(row[-1]) > _BYTES):
            yield batch()
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        yield batch()


def _projects(library: str) -> Iterator[tuple[str]]:
    with os.scandir(library) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False) and not _OWN.fullmatch(e.name):
                yield (e.name,)


def _files(library: str, document: str) -> Iterator[tuple[str, str]]:
    """(document, path) of all files of a project, hidden ones too; what is neither file nor folder is refused."""
    rest = [""]
    while rest:
        at = rest.pop()
        with os.scandir(os.path.join(library, document, at)) as entries:
            for e in entries:
                path = os.path.join(at, e.name)
                if e.is_dir(follow_symlinks=False):
                    rest.append(path)
                elif e.is_file(follow_symlinks=False):
                    yield document, path
                else:
                    raise ValidationError(f"Only files and folders are supported: {e.path}")


def _read(library: str, document: str, path: str) -> tuple[str, str, bytes]:
    with open(os.path.join(library, document, path), "rb") as f:
        return document, path, f.read()


def read_projects(spark: SparkSession, library: str) -> DataFrame:
    """Rows (document_id, path, content) of the files of all projects of a library; files beside the projects are no rows.

    A task lists the library, tasks list the projects, and their files are dealt anew to be read, so a project with most of the
    files is read by all tasks.  Spark's own reader of files would hold every name on the driver, and a task for a few files.
    """
    library = os.path.abspath(library)
    tasks = max(_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def projects(batches):
        for _ in batches:
            yield from _batches(_projects(library), ("document_id",))

    def files(batches):
        yield from _batches((x for b in batches for d in b.column(0).to_pylist() for x in _files(library, d)), ("document_id", "path"))

    def contents(batches):
        yield from _batches((_read(library, d, p) for b in batches for d, p in zip(*(c.to_pylist() for c in b.columns))), ("document_id", "path", "content"))

    rows = spark.range(0, 1, 1, 1).mapInArrow(projects, "document_id string")
    rows = rows.repartition(tasks, "document_id").mapInArrow(files, "document_id string, path string")
    return rows.repartition(tasks, "document_id", "path").mapInArrow(contents, FILES)
