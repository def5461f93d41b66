"""EPUB extraction: archive entries, package, spine, chapters, images and links as DataFrames.

ZIP and XML are parsed by Arrow functions, one archive entry a row; everything after that is joins and windows.
A bad archive gives an error row and does not stop the others.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.text import slug_exact
from ..operators import links as L
from ..operators import units as U
from ..operators.markdown import html_to_markdown
from ..operators.stage import staged

#: Images up to this width and height that a chapter refers to twice or more are decoration.
DECORATIVE_SIZE, DECORATIVE_REFERENCES = 16, 2
_LOCATION = "source_path string, page int, spine_index int, selector string, confidence double"
#: Entries that a task holds before it hands them on; a larger entry goes alone.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1024
_ENTRY_TYPES = (pa.string(), pa.string(), pa.binary(), pa.string())


def entries(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sources(document_id, content)`` -> entries (document_id, entry_path, bytes) and failures (document_id, code, message)."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ENTRY_TYPES)], ["document_id", "entry_path", "bytes", "error"])

    def run(batches: Iterator[pa.RecordBatch]):
        for found in batches:
            rows, held = [], 0
            for document, content in zip(found.column(0), found.column(1)):  # one archive, and one entry of it, at a time
                document, content = document.as_py(), content.as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = _readable(z)
                        for name in names:
                            rows.append((document, name, z.read(name), None))
                            held += len(rows[-1][2])
                            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                                yield batch(rows)
                                rows, held = [], 0
                except Exception as error:
                    rows.append((document, None, None, f"Unable to read the archive: {error}"))
                    if len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    rows = staged(sources.select("document_id", "content").mapInArrow(run, "document_id string, entry_path string, bytes binary, error string"))
    bad = rows.where("error is not null").select("document_id", F.lit("malformed-source").alias("code"), F.col("error").alias("message"))
    return rows.where("error is null").drop("error"), bad


def _readable(z: zipfile.ZipFile) -> list[str]:
    """Names of an archive's files, all read once in pieces: an archive that breaks in its middle gives an error and no entries."""
    names = [n for n in z.namelist() if not n.endswith("/")]
    if "mimetype" not in names:
        raise ValueError("mimetype is missing")
    for name in names:
        with z.open(name) as f:
            while f.read(1 << 20):
                pass
    return names


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1].lower()


def _xml(text: str | None):
    try:
        return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text or ""))
    except ET.ParseError:
        return None


_PACKAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "href", "media_type")]))),
    T.StructField("spine", T.ArrayType(T.StringType())),
])


@F.pandas_udf(T.StringType())
def _rootfile(xml: pd.Series) -> pd.Series:
    def one(x):
        root = _xml(x)
        return None if root is None else next((e.get("full-path") for e in root.iter() if _local(e.tag) == "rootfile" and e.get("full-path")), None)

    return xml.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cipher_uris(xml: pd.Series) -> pd.Series:
    def one(x):
        root = _xml(x)
        return [] if root is None else [e.get("URI") or "" for e in root.iter() if _local(e.tag) == "cipherreference"]

    return xml.map(one)


@F.pandas_udf(_PACKAGE)
def _package(xml: pd.Series) -> pd.DataFrame:
    def one(x):
        root = _xml(x)
        if root is None:
            return None, None, [], []
        first = lambda name: next((" ".join("".join(e.itertext()).split()) for e in root.iter() if _local(e.tag) == name), None)
        items = [{"id": e.get("id"), "href": e.get("href"), "media_type": e.get("media-type")} for e in root.iter() if _local(e.tag) == "item" and e.get("id") and e.get("href")]
        spine = [e.get("idref") or "" for e in root.iter() if _local(e.tag) == "itemref"]
        return first("title"), first("language"), items, spine

    return pd.DataFrame([one(x) for x in xml], columns=["title", "language", "items", "spine"])


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, JPEG or WebP file."""
    if not data:
        return None
    try:
        if data[:4] == b"\x89PNG":
            return struct.unpack(">II", data[16:24])
        if data[:3] == b"GIF":
            return struct.unpack("<HH", data[6:10])
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            if data[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF
            return None
        if data[:2] == b"\xff\xd8":
            i = 2
            while i + 9 < len(data):
                if data[i] != 0xFF:
                    return None
                if data[i + 1] in range(0xC0, 0xD0) and data[i + 1] not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                    return w, h
                i += 2 + int.from_bytes(data[i + 2 : i + 4], "big")
    except struct.error:
        return None
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def measured(content: pd.Series) -> pd.DataFrame:
    sizes = [image_size(x) or (None, None) for x in content]
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")


@F.pandas_udf(T.StringType())
def _slug(s: pd.Series) -> pd.Series:
    return s.map(slug_exact, na_action="ignore")


@dataclass
class Extracted:
    """Units, assets, warnings and failures of all documents, and one metadata row per document."""

    documents: DataFrame
    units: DataFrame
    assets: DataFrame
    warnings: DataFrame
    failures: DataFrame


def _warning(df: DataFrame, code: str, message, selector=None) -> DataFrame:
    place = F.struct(F.col("document_id").alias("source_path"), F.lit(None).cast("int").alias("page"), (F.col("spine_index") if "spine_index" in df.columns else F.lit(None)).cast("int").alias("spine_index"), (F.lit(None) if selector is None else selector).cast("string").alias("selector"), F.lit(None).cast("double").alias("confidence"))
    return df.select("document_id", F.lit(code).alias("code"), message.alias("message"), F.lit("warning").alias("severity"), place.alias("location"))


def _entry(all_entries: DataFrame, path: str) -> DataFrame:
    return all_entries.where(F.col("entry_path") == path).select("document_id", X.decode_text(F.col("bytes")).alias("xml"))


def extract(sources: DataFrame) -> Extracted:
    """``sources(document_id, content)`` of EPUB archives."""
    every, failures = entries(sources)
    ids = every.select("document_id").distinct()
    # encryption: only fonts may be encrypted
    locked = _entry(every, "META-INF/encryption.xml").withColumn("uris", _cipher_uris("xml"))
    locked = locked.withColumn("fonts", (F.size("uris") > 0) & F.forall("uris", lambda u: u.startswith("fonts/")))
    failures = failures.unionByName(locked.where("not fonts").select("document_id", F.lit("encrypted-source").alias("code"), F.lit("The source is encrypted.").alias("message")))
    warnings = _warning(locked.where("fonts"), "unsupported-structure", F.lit("Encrypted fonts were ignored."))
    # package
    container = _entry(every, "META-INF/container.xml").withColumn("entry_path", _rootfile("xml")).drop("xml")
    package = container.join(every, ["document_id", "entry_path"]).select("document_id", "entry_path", _package(X.decode_text(F.col("bytes"))).alias("p"))
    missing = ids.join(package.where(F.size("p.spine") > 0), "document_id", "left_anti").join(failures.select("document_id"), "document_id", "left_anti")
    failures = failures.unionByName(missing.select("document_id", F.lit("malformed-source").alias("code"), F.lit("The package document was not found or has no spine.").alias("message")))
    good = staged(package.join(failures.select("document_id").distinct(), "document_id", "left_anti").withColumn("base", X.dirname(F.col("entry_path"))))
    blank = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    documents = good.select("document_id", blank("p.title", "Untitled document").alias("title"), blank("p.language", "und").alias("language"))
    # spine: last item of an id wins
    items = good.select("document_id", "base", F.posexplode("p.items").alias("n", "i"))
    last = W.partitionBy("document_id", "id").orderBy(F.desc("n"))
    items = items.select("document_id", "n", F.col("i.id").alias("id"), X.resolve_archive_path(F.col("base"), F.col("i.href")).alias("path"))
    items = items.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "n")
    spine = good.select("document_id", F.posexplode("p.spine").alias("spine_index", "id")).join(items, ["document_id", "id"], "left")
    spine = spine.join(every.select("document_id", F.col("entry_path").alias("path"), "bytes"), ["document_id", "path"], "left")
    lost = spine.where(F.col("bytes").isNull())
    warnings = warnings.unionByName(_warning(lost, "unresolved-resource", F.concat(F.lit("Spine item was not found: "), F.col("id"))))
    chapters = staged(spine.where(F.col("bytes").isNotNull()).select("document_id", "spine_index", "path", html_to_markdown(X.decode_text(F.col("bytes"))).alias("markdown")))
    unread = chapters.where(F.col("markdown").isNull())
    warnings = warnings.unionByName(_warning(unread, "dropped-content", F.concat(F.lit("Chapter could not be read: "), F.col("path"))))
    chapters, assets, more = _images(chapters.where(F.col("markdown").isNotNull()), every)
    chapters, assets = staged(chapters), staged(assets)
    warnings = warnings.unionByName(more)
    # titles, merge, ids, links
    chapters = chapters.withColumn("title", X.derive_title(F.col("markdown")))
    merged = U.merge_title_pages(chapters, "document_id", "spine_index", ~X.is_title_only(F.col("markdown")), X.is_empty_chapter(F.col("markdown")))
    units = U.numbered(merged, "document_id", "spine_index", wide=("markdown",))
    of_path = units.select("document_id", F.explode("paths").alias("target"), F.col("unit_id").alias("new"))
    units, more = L.rewrite_internal_links(units, of_path)
    warnings = warnings.unionByName(_warning(more, "unresolved-resource", F.col("message")))
    assets = L.used_assets(assets, L.asset_references(units))
    place = F.struct(F.col("path").alias("source_path"), F.lit(None).cast("int").alias("page"), "spine_index", F.lit(None).cast("string").alias("selector"), F.lit(None).cast("double").alias("confidence"))
    units = units.select("document_id", "pos", "unit_id", "title", X.unit_path(F.col("pos"), F.col("title")).alias("path"), place.alias("source"), "markdown")
    seq = F.row_number().over(W.partitionBy("document_id").orderBy("location.spine_index", "code", "message"))
    return Extracted(documents, units, assets, warnings.withColumn("seq", seq), failures)


def _images(chapters: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chapters with image links to assets, the assets, and warnings."""
    keys = ["document_id", "spine_index", "path"]
    found = chapters.select(*keys, F.posexplode(F.regexp_extract_all("markdown", F.lit(X.MARKDOWN_IMAGE), F.lit(0))).alias("n", "image"))
    part = lambda c, n: F.regexp_extract(c, "(?s)^" + X.MARKDOWN_IMAGE + "$", n)
    src = part(F.col("image"), 2)
    refs = found.withColumn("src", src).where(~X.is_data_source(F.col("src")) & ~X.is_external_href(F.col("src")))
    refs = refs.withColumn("resource", X.resolve_archive_path(X.dirname(F.col("path")), F.col("src"))).withColumn("alt", part(F.col("image"), 1)).drop("image")
    have = every.select("document_id", F.col("entry_path").alias("resource"), "bytes").join(refs.select("document_id", "resource").distinct(), ["document_id", "resource"], "left_semi")
    have = have.withColumns({"fmt": X.image_format(F.col("bytes")), "size": measured("bytes")})
    # decoration: twice or more in a chapter and small
    often = refs.groupBy("document_id", "spine_index", "resource").agg(F.count("*").alias("c")).where(F.col("c") >= DECORATIVE_REFERENCES)
    small = have.where((F.col("size.width") <= DECORATIVE_SIZE) & (F.col("size.height") <= DECORATIVE_SIZE)).select("document_id", "resource")
    decorative = often.join(small, ["document_id", "resource"], "left_semi").select("document_id", "spine_index", "resource").withColumn("decorative", F.lit(True))
    warnings = _warning(decorative.select("document_id", "resource").distinct(), "decorative-image", F.concat(F.lit("Small reused image was treated as decorative: "), F.col("resource")), F.col("resource"))
    shown = refs.join(decorative, ["document_id", "spine_index", "resource"], "left_anti").join(have.drop("bytes"), ["document_id", "resource"], "left")
    warnings = warnings.unionByName(_warning(shown.where("fmt is null and size is null").select("document_id", "resource", "spine_index").distinct(), "unresolved-resource", F.concat(F.lit("Image resource was not found: "), F.col("resource")), F.col("resource")))
    warnings = warnings.unionByName(_warning(shown.where("fmt is null and size is not null").select("document_id", "resource", "spine_index").distinct(), "unsupported-structure", F.concat(F.lit("Image format is not supported: "), F.col("resource")), F.col("resource")))
    known = shown.where("fmt is not null").withColumn("at", F.struct("spine_index", "n"))
    numbers = L.first_seen_ids(known, "document_id", "resource", "at")
    first_alt = known.groupBy("document_id", "resource").agg(F.min_by("alt", "at").alias("alt_text"), F.first("fmt").alias("fmt"), F.first("size").alias("size"))
    assets = numbers.join(first_alt, ["document_id", "resource"]).withColumn("extension", F.when(F.col("fmt") == "jpeg", ".jpg").otherwise(F.concat(F.lit("."), F.col("fmt"))))
    stem = F.regexp_extract("resource", "([^/]*?)(?:\\.[^./]*)?$", 1)
    assets = L.suffixed_names(assets.withColumn("stem", _slug(stem)), "document_id", "stem", "extension", "first_at")
    assets = assets.withColumn("path", F.concat(F.lit("assets/images/"), F.col("file_name")))
    # rewrite: decoration and missing images go, others link to their asset
    links = assets.select("document_id", F.col("resource").alias("target"), X.chapter_asset_link(F.col("path")).alias("new"))
    gone = decorative.select("document_id", "spine_index", F.col("resource").alias("target"), F.lit("").alias("new"))
    table = refs.select("document_id", "spine_index", F.col("resource").alias("target")).distinct().join(links, ["document_id", "target"], "left")
    table = table.join(gone.drop("new"), ["document_id", "spine_index", "target"], "left_anti").where("new is not null")
    piece = F.col("__piece")
    own = X.is_data_source(part(piece, 2)) | X.is_external_href(part(piece, 2))
    base = X.dirname(F.col("path"))
    target = F.when(~own, F.coalesce(X.resolve_archive_path(base, part(piece, 2)), F.lit("")))
    title = F.when(piece.rlike(r'\s+"[^"]*"\)[ \t]*$'), F.concat(F.lit(' "'), part(piece, 3), F.lit('"'))).otherwise("")
    linked = F.concat(F.lit("!["), part(piece, 1), F.lit("]("), F.col("new"), title, F.lit(")"), part(piece, 4))
    rebuilt = F.when(F.col("target").isNull(), piece).otherwise(F.coalesce(linked, F.lit("")))
    chapters, _ = L.rewrite_by_join(chapters, keys, X.MARKDOWN_IMAGE, target, table, rebuilt)
    mime = F.concat(F.lit("image/"), F.col("fmt"))
    stored = assets.join(have.select("document_id", "resource", "bytes"), ["document_id", "resource"])
    return chapters, stored.select("document_id", "asset_id", "path", "bytes", mime.alias("mime_type"), F.nullif(F.col("alt_text"), F.lit("")).alias("alt_text"), F.col("size.width").cast("double").alias("width"), F.col("size.height").cast("double").alias("height")), warnings


def archive_path(base: str, href: str) -> str:
    """The same resolution for one link on the driver."""
    from urllib.parse import unquote

    path = posixpath.normpath(posixpath.join(base, unquote(href.split("#", 1)[0])))
    if path == ".." or path.startswith("../"):
        raise ValueError(f"EPUB resource escapes the archive: {href}")
    return path
