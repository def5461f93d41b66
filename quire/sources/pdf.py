"""PDF extraction: page texts by an Arrow function, then lines, sections and images as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.pdf_text import Pdf
from ..operators import links as L
from ..operators import units as U
from ..operators.stage import staged
from .epub import BATCH_BYTES, BATCH_ROWS, Extracted, _slug, measured

_PAGES = "document_id string, title string, page int, text string, images array<struct<name:string,bytes:binary>>, code string, message string"
_PAGE_TYPES = {"document_id": pa.string(), "title": pa.string(), "page": pa.int32(), "text": pa.string(), "images": pa.list_(pa.struct([("name", pa.string()), ("bytes", pa.binary())])), "code": pa.string(), "message": pa.string()}


def pages(sources: DataFrame) -> DataFrame:
    """``sources(document_id, content)`` -> one row per page with its text and images, or one error row."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PAGE_TYPES.values())], list(_PAGE_TYPES))

    def read(document: str, content: bytes) -> list[tuple]:
        try:
            pdf = Pdf(content)
            title = pdf.title()
            rows = [(document, title, n + 1, pdf.page_text(page), [{"name": a, "bytes": b} for a, b in pdf.page_images(page)], None, None) for n, page in enumerate(pdf.pages())]
            return rows if any(r[3].strip() for r in rows) else [(document, None, None, None, [], "missing-text", "The PDF has no text layer.")]
        except PermissionError as error:
            return [(document, None, None, None, [], "encrypted-source", str(error))]
        except Exception as error:
            return [(document, None, None, None, [], "malformed-source", f"Unable to read the PDF: {error}")]

    def run(batches: Iterator[pa.RecordBatch]):
        for found in batches:
            rows, held = [], 0
            for document, content in zip(found.column(0), found.column(1)):  # one file at a time
                rows += read(document.as_py(), content := content.as_py())
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return sources.select("document_id", "content").mapInArrow(run, _PAGES)


def extract(sources: DataFrame) -> Extracted:
    """``sources(document_id, content)`` of PDF files."""
    rows = staged(pages(sources))
    failures = rows.where("code is not null").select("document_id", "code", "message")
    good = rows.where("code is null")
    documents = good.groupBy("document_id").agg(F.first("title", ignorenulls=True).alias("title")).select("document_id", F.coalesce("title", "document_id").alias("title"), F.lit("und").alias("language"))
    units = staged(U.sections(good.select("document_id", "page", "text"), "document_id", "page"))
    numbered = F.lit("").cast("string")
    images = good.select("document_id", "page", F.posexplode("images").alias("n", "image")).select("document_id", "page", "n", F.col("image.name").alias("name"), F.col("image.bytes").alias("bytes"))
    images = images.withColumns({"fmt": X.image_format(F.col("bytes")), "size": measured("bytes"), "stem": _slug(X.image_stem(F.col("name")))})
    dropped = images.where("fmt is null")
    order = F.row_number().over(W.partitionBy("document_id").orderBy("page", "n"))
    images = images.where("fmt is not null").withColumn("asset_id", F.format_string("asset-%03d", order))
    images = images.withColumns({"extension": F.when(F.col("fmt") == "jpeg", ".jpg").otherwise(F.concat(F.lit("."), F.col("fmt"))), "at": F.struct("page", "n")})
    images = L.suffixed_names(images, "document_id", "stem", "extension", "at").withColumn("path", F.concat(F.lit("assets/images/"), F.col("file_name")))
    attached = U.attach_backward(images.select("document_id", "page", "n", "path"), units.select("document_id", F.col("page").alias("starts"), "pos"), "document_id", "page", "starts", "pos")
    marks = attached.groupBy("document_id", F.col("attached").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: F.concat(F.lit("![]("), X.chapter_asset_link(x["path"]), F.lit(")"))), "\n\n").alias("shown"))
    units = units.join(marks, ["document_id", "pos"], "left").withColumn("markdown", F.concat_ws("\n\n", "markdown", F.coalesce("shown", numbered)))
    units = units.withColumn("markdown", F.regexp_replace("markdown", "\n\n$", ""))
    place = lambda page, confidence: F.struct(F.col("document_id").alias("source_path"), page.cast("int").alias("page"), F.lit(None).cast("int").alias("spine_index"), F.lit(None).cast("string").alias("selector"), confidence.cast("double").alias("confidence"))
    out = units.select("document_id", "pos", "unit_id", "title", X.unit_path(F.col("pos"), F.col("title")).alias("path"), place(F.col("page"), F.col("confidence")).alias("source"), "markdown")
    none = F.lit(None)
    warn = lambda df, code, message: df.select("document_id", F.lit(code).alias("code"), message.alias("message"), F.lit("warning").alias("severity"), place(F.col("page"), none).alias("location"))
    warnings = warn(U.section_warnings(units, "document_id"), "ambiguous-structure", F.col("message"))
    early = attached.where("low_confidence").select("document_id", F.col("n"), "path").join(images.select("document_id", "path", "page"), ["document_id", "path"])
    warnings = warnings.unionByName(warn(early, "low-confidence", F.format_string("Image on page %d appears before the first section; it was attached to the first unit.", F.col("page"))))
    warnings = warnings.unionByName(warn(dropped, "dropped-content", F.format_string("Image on page %d could not be read.", F.col("page"))))
    seq = F.row_number().over(W.partitionBy("document_id").orderBy("location.page", "code", "message"))
    assets = images.select("document_id", "asset_id", "path", "bytes", F.concat(F.lit("image/"), F.col("fmt")).alias("mime_type"), F.lit(None).cast("string").alias("alt_text"), F.col("size.width").cast("double").alias("width"), F.col("size.height").cast("double").alias("height"))
    return Extracted(documents, out, assets, warnings.withColumn("seq", seq), failures)
