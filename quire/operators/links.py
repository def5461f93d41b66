"""Links and assets: extraction, rewriting by join, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .markdown import attribute_values
from .scan import scan


def html_targets(pages: DataFrame, html: str = "html", attribute: str = "href") -> DataFrame:
    """One row per attribute value of a tag, in order: ``link_no`` from 1 and ``href``."""
    found = attribute_values(F.col(html), attribute)
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("__n", "href")).withColumn("link_no", F.col("__n") + 1).drop("__n")


def asset_references(units: DataFrame, document: str = "document_id", markdown: str = "markdown") -> DataFrame:
    """Distinct asset paths that units refer to."""
    found = F.regexp_extract_all(F.coalesce(F.col(markdown), F.lit("")), F.lit(X.ASSET_REFERENCE), F.lit(1))
    return units.select(document, F.explode(found).alias("path")).distinct()


def used_assets(assets: DataFrame, references: DataFrame, keys: tuple[str, ...] = ("document_id", "path")) -> DataFrame:
    return assets.join(references, list(keys), "left_semi")


def unused_assets(assets: DataFrame, references: DataFrame, keys: tuple[str, ...] = ("document_id", "path")) -> DataFrame:
    return assets.join(references, list(keys), "left_anti")


def _pieces(df: DataFrame, markdown: str, pattern: str) -> DataFrame:
    """Matches of ``pattern`` and the text between them, one row per piece: ``__k`` odd for matches."""
    text = F.coalesce(F.col(markdown), F.lit(""))
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.flatten(F.transform(between, lambda x, i: F.when(i < F.size(found), F.array(x, F.get(found, i))).otherwise(F.array(x))))
    return df.select("*", F.posexplode(both).alias("__k", "__piece"))


def rewrite_by_join(units: DataFrame, keys: list[str], pattern: str, target: Column, table: DataFrame, rebuilt: Column, markdown: str = "markdown") -> tuple[DataFrame, DataFrame]:
    """Rewrite every match of ``pattern``: explode, left join on the keys and ``target``, rebuild in order.

    ``target`` and ``rebuilt`` are expressions over ``__piece``; ``table`` has the keys it is joined by, ``target`` and ``new``.
    Returns the units and the matches without a row in ``table``.
    """
    pieces = _pieces(units.select(*keys, markdown), markdown, pattern).drop(markdown).withColumn("__match", F.col("__k") % 2 == 1)
    pieces = pieces.withColumn("target", F.when(F.col("__match"), target))
    by = [c for c in table.columns if c != "new"]
    joined = pieces.join(table, by, "left")
    text = F.when(F.col("__match"), rebuilt).otherwise(F.col("__piece"))
    done = joined.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", text.alias("t")))), lambda x: x["t"]), "").alias(markdown))
    missing = joined.where(F.col("__match") & F.col("target").isNotNull() & F.col("new").isNull()).select(*keys, "target", "__k")
    return units.drop(markdown).join(done, keys, "left"), missing


def remap_read_links(units: DataFrame, ids: DataFrame, document: str = "document_id") -> DataFrame:
    """``(/read/unit-N#f)`` through ``ids(document, target, new)``; links to units that are gone become ``(#)``."""
    pattern = r"\(/read/unit-\d+(?:#[^)\s]*)?\)"
    target = F.regexp_extract("__piece", r"/read/(unit-\d+)", 1)
    fragment = F.regexp_extract("__piece", r"(#[^)\s]*)\)$", 1)
    rebuilt = F.coalesce(F.concat(F.lit("(/read/"), F.col("new"), fragment, F.lit(")")), F.lit("(#)"))
    out, _ = rewrite_by_join(units, [document, "unit_id"], pattern, target, ids, rebuilt)
    return out


def rewrite_internal_links(units: DataFrame, unit_of_path: DataFrame, document: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Links between chapters to ``/read/<unit>#fragment``; needs ``path``; unknown targets become ``(#)`` and a warning row.

    ``unit_of_path(document, target, new)``: archive path -> unit id.
    """
    units = units.withColumn("__base", X.dirname(F.col("path")))
    keys = [document, "unit_id", "__base"]
    part = lambda n: F.regexp_extract("__piece", "(?s)^" + X.MARKDOWN_LINK.replace("(?<!!)", "") + "$", n)
    href = part(2)
    own = (href == "") | href.startswith("#") | href.startswith("/read/") | X.is_external_href(href) | (F.element_at(F.split(href, "#", 2), 1) == "")
    target = F.when(~own, F.coalesce(X.resolve_archive_path(F.col("__base"), href), F.lit("")))
    fragment = F.when(F.contains(href, F.lit("#")), F.concat(F.lit("#"), F.element_at(F.split(href, "#"), 2))).otherwise("")
    title = F.when(F.col("__piece").rlike(r'\s+"[^"]*"\)$'), F.concat(F.lit(' "'), part(3), F.lit('"'))).otherwise("")
    moved = F.concat(F.lit("["), part(1), F.lit("](/read/"), F.col("new"), fragment, title, F.lit(")"))
    rebuilt = F.when(F.col("target").isNull(), F.col("__piece")).otherwise(F.coalesce(moved, F.concat(F.lit("["), part(1), F.lit("](#)"))))
    out, missing = rewrite_by_join(units, keys, X.MARKDOWN_LINK, target, unit_of_path, rebuilt)
    warnings = missing.select(document, "unit_id", F.lit("unresolved-resource").alias("code"), F.concat(F.lit("Internal link target was not found: "), F.col("target")).alias("message"))
    return out.drop("__base"), warnings


def first_seen_ids(references: DataFrame, document: str, resource: str, order: str, prefix: str = "asset") -> DataFrame:
    """``asset-NNN`` in the order in which resources are first referred to."""
    first = references.groupBy(document, resource).agg(F.min(order).alias("first_at"))
    return scan(first, document, "first_at", resource, before={"n": F.lit(1)}).withColumn("asset_id", F.format_string(prefix + "-%03d", F.col("n") + 1)).drop("n")


def suffixed_names(rows: DataFrame, document: str, stem: str, extension: str, order: str) -> DataFrame:
    """``name``, ``name-2``, ``name-3`` for equal stems of a document; numbers that another row's own stem has are left out, so names differ."""
    w = W.partitionBy(document, stem, extension).orderBy(order)
    numbered = rows.withColumn("__n", F.row_number().over(w))
    ending = r"^(.*)-([1-9]\d{0,8})$"
    taken = rows.where(F.col(stem).rlike(ending)).select(document, F.regexp_extract(stem, ending, 1).alias("__stem"), F.col(extension).alias("__ext"), F.regexp_extract(stem, ending, 2).cast("int").alias("__k"))
    taken = taken.groupBy(document, "__stem", "__ext").agg(F.collect_set("__k").alias("__taken")).withColumnRenamed(document, "__doc")
    same = F.col(document).eqNullSafe(F.col("__doc")) & (F.col(stem) == F.col("__stem")) & (F.col(extension) == F.col("__ext")) & (F.col("__n") > 1)
    both = numbered.join(taken, same, "left")
    # the n-th row takes the (n - 1)-th number from 2 on that is free
    free = F.array_except(F.sequence(F.lit(2), F.col("__n") + F.size("__taken")), F.col("__taken"))
    number = F.when(F.col("__taken").isNull(), F.col("__n")).otherwise(F.get(free, F.col("__n") - 2))
    suffix = F.when(F.col("__n") > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise("")
    return both.withColumn("file_name", F.concat(F.col(stem), suffix, F.col(extension))).drop("__n", "__doc", "__stem", "__ext", "__taken")


def collisions(rows: DataFrame, *keys: str, member: str) -> DataFrame:
    """Groups of more than one row with equal keys, members in order."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(member)), ", ").alias("members")).where("n > 1")
