"""Manifests: creation from units and assets, and validation as a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X


def create(documents: DataFrame, units: DataFrame, assets: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, manifest) of ``documents(document, title, language, format, path, size)``."""
    place = F.struct(F.col("source.source_path").alias("sourcePath"), F.col("source.page").alias("page"), F.col("source.spine_index").alias("spineIndex"), F.col("source.selector").alias("selector"), F.col("source.confidence").alias("confidence"))
    ordered = lambda fields, by: F.transform(F.array_sort(F.collect_list(F.struct(by, fields.alias("v")))), lambda x: x["v"])
    u = units.groupBy(document).agg(ordered(F.struct(F.col("unit_id").alias("id"), "title", "path", place.alias("source")), "pos").alias("units"))
    a = assets.groupBy(document).agg(ordered(F.struct(F.col("asset_id").alias("id"), "path", F.col("mime_type").alias("mimeType"), F.col("alt_text").alias("altText"), "width", "height"), "asset_id").alias("assets"))
    rows = documents.join(u, document).join(a, document, "left")
    language = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("und"))
    none = F.array().cast(schemas.schema(schemas.MANIFEST)["assets"].dataType)
    manifest = F.struct(
        F.lit(schemas.MANIFEST_VERSION).alias("schemaVersion"), F.col(document).alias("id"), "title", language.alias("language"), X.direction(language).alias("direction"),
        F.struct("format", "path", F.col("size").cast("double").alias("size")).alias("source"), "units", F.coalesce("assets", none).alias("assets"),
        F.struct(F.lit("templates/base.html").alias("base"), F.lit("templates/print.css").alias("styles")).alias("templates"),
    )
    return rows.select(document, manifest.alias("manifest"))


def _text(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def _relative(c: Column, start: str = "", end: str = "") -> Column:
    path = X.manifest_path(c)
    ok = _text(c) & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & path.startswith(start) & path.endswith(end)
    return F.coalesce(ok, F.lit(False))


def rules(m: Column) -> list[tuple[str, Column, str]]:
    """(field, holds, message) in the order in which they are judged."""
    units, assets = m["units"], m["assets"]
    every = lambda xs, f: F.coalesce(F.forall(xs, f), F.lit(False))
    unique = lambda xs, key: F.coalesce(F.size(F.array_distinct(F.transform(xs, lambda x: x[key]))) == F.size(xs), F.lit(False))
    size = m["source"]["size"]
    return [
        ("schemaVersion", m["schemaVersion"].eqNullSafe(schemas.MANIFEST_VERSION), f"manifest schemaVersion must be {schemas.MANIFEST_VERSION}"),
        ("id", F.coalesce(X.is_safe_name(m["id"]), F.lit(False)), "Invalid document name"),
        ("title", _text(m["title"]), "title must be a non-empty string"),
        ("language", _text(m["language"]), "language must be a non-empty string"),
        ("direction", F.coalesce(m["direction"].isin("ltr", "rtl"), F.lit(False)), "direction must be ltr or rtl"),
        ("source.format", F.coalesce(m["source"]["format"].isin("epub", "pdf"), F.lit(False)), "source.format must be epub or pdf"),
        ("source.path", _relative(m["source"]["path"]), "source.path must stay inside the document directory"),
        ("source.size", F.coalesce((size >= 0) & ~F.isnan(size) & (size < float("inf")), F.lit(False)), "source.size must be a non-negative number"),
        ("units", F.coalesce(F.size(units) > 0, F.lit(False)), "units must contain at least one unit"),
        ("units.source", every(units, lambda u: u["source"]["sourcePath"].isNotNull()), "units[].source is invalid"),
        ("units.id", every(units, lambda u: F.coalesce(X.is_safe_name(u["id"]), F.lit(False))), "units[].id must be a safe unit identifier"),
        ("units.title", every(units, lambda u: _text(u["title"])), "units[].title must be a non-empty string"),
        ("units.path", every(units, lambda u: _relative(u["path"], "chapters/", ".md")), "units[].path must be a Markdown file under chapters/"),
        ("units.id", unique(units, "id"), "units must have unique ids"),
        ("units.path", unique(units, "path"), "units must have unique paths"),
        ("assets", assets.isNotNull(), "assets must be an array"),
        ("assets.id", every(assets, lambda a: _text(a["id"])), "assets[].id must be a non-empty string"),
        ("assets.path", every(assets, lambda a: _relative(a["path"], "assets/images/")), "assets[].path must be under assets/images/"),
        ("assets.mimeType", every(assets, lambda a: _text(a["mimeType"])), "assets[].mimeType must be a non-empty string"),
        ("assets.altText", every(assets, lambda a: a["altText"].isNull() | _text(a["altText"])), "assets[].altText must be a non-empty string"),
        ("assets.id", unique(assets, "id"), "assets must have unique ids"),
        ("assets.path", unique(assets, "path"), "assets must have unique paths"),
        ("templates.base", _relative(m["templates"]["base"], "templates/"), "templates.base must be under templates/"),
        ("templates.styles", _relative(m["templates"]["styles"], "templates/"), "templates.styles must be under templates/"),
    ]


def violations(manifests: DataFrame, document: str = "document_id", column: str = "manifest") -> DataFrame:
    """(document, rule_no, field, message): every rule that a manifest breaks; the smallest rule_no is the first."""
    broken = [F.when(~ok, F.struct(F.lit(i + 1).alias("rule_no"), F.lit(field).alias("field"), F.lit(message).alias("message"))) for i, (field, ok, message) in enumerate(rules(F.col(column)))]
    return manifests.select(document, F.explode(F.array_compact(F.array(*broken))).alias("v")).select(document, "v.*")
