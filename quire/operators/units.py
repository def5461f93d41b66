"""Ordered units: numbering, navigation, sections, title pages, renumbering and concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import text as X
from .scan import scan


def numbered(df: DataFrame, document: str, *order: str, wide: tuple[str, ...] = (), neighbours: bool = False) -> DataFrame:
    """``df`` with ``pos`` (from 1) and ``unit_id`` per document; a later ``pos`` and ``unit_id`` replace earlier ones.

    ``neighbours`` adds ``prev_id`` and ``next_id``, ids of the units before and after.  ``wide``: texts that stay out of the sort.
    """
    one = {"__n": F.lit(1)}
    rows = scan(df.drop("pos", "unit_id"), document, *order, wide=wide, before=one, lead={"__next": F.lit(1)} if neighbours else None)
    rows = rows.withColumn("pos", (F.col("__n") + 1).cast("int")).withColumn("unit_id", X.unit_id(F.col("pos")))
    if neighbours:
        rows = rows.withColumns({"prev_id": F.when(F.col("pos") > 1, X.unit_id(F.col("pos") - 1)), "next_id": F.when(F.col("__next").isNotNull(), X.unit_id(F.col("pos") + 1))})
    return rows.drop("__n", "__next")


def navigation(units: DataFrame, document: str = "document_id", wide: tuple[str, ...] = ()) -> DataFrame:
    """Previous and next unit of each unit."""
    return scan(units, document, "pos", wide=wide, lag={"prev_id": F.col("unit_id")}, lead={"next_id": F.col("unit_id")})


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """Lines of page texts (column ``line``, ``line_no``) without blanks and page markers, and ``is_heading``."""
    rows = pages.select("*", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "line")).drop(text)
    rows = rows.withColumn("line", X.normalize_text(F.col("line")))
    return rows.where((F.col("line") != "") & ~X.is_page_marker(F.col("line"))).withColumn("is_heading", X.is_heading_line(F.col("line")))


def sections(pages: DataFrame, document: str, page: str, text: str = "text") -> DataFrame:
    """Units of the lines of ordered pages: every heading starts one; lines before the first form the unit ``Document``.

    -> (document, pos, unit_id, title, page, line_no, confidence, n_lines, markdown); ``page`` and ``line_no`` are those of a unit's
    first line.  A document without a heading is one unit of confidence 0.5, others have 0.8; one without a line has none.

    Each page cuts its own lines at its headings; how many headings came before a page is a scan over numbers.  Only the
    pieces of a section that goes on over a page's edge meet.
    """
    split = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x, i: F.struct(X.normalize_text(x).alias("line"), i.alias("no")))
    lines = F.filter(split, lambda x: (x["line"] != "") & ~X.is_page_marker(x["line"]))
    block = lambda x: F.concat(F.when(x["heading"], F.lit("# ")).otherwise(""), X.escape_markdown(x["line"]))
    rows = pages.select(F.col(document).alias(document), F.col(page).alias("page"), lines.alias("__lines"))
    rows = rows.withColumn("__lines", F.transform("__lines", lambda x: F.struct(x["line"].alias("line"), x["no"].alias("no"), X.is_heading_line(x["line"]).alias("heading"))))
    rows = rows.withColumn("__at", F.filter(F.transform("__lines", lambda x, i: F.when(x["heading"], i + 1)), lambda i: i.isNotNull()))
    rows = rows.withColumn("__starts", F.concat(F.array(F.lit(1)), "__at"))
    stop = lambda j: F.coalesce(F.get("__starts", j + 1), F.size("__lines") + 1)
    pieces = F.transform("__starts", lambda start, j: F.struct(j.alias("local"), F.slice("__lines", start, stop(j) - start).alias("lines")))
    rows = rows.select(document, "page", F.size("__at").alias("__headings"), F.when(F.size("__lines") > 0, ~F.get("__lines", F.lit(0))["heading"]).alias("__opens"), F.filter(pieces, lambda x: F.size(x["lines"]) > 0).alias("__pieces"))
    placed = scan(rows, document, "page", wide=("__pieces",), before={"__carry": F.col("__headings")}, first={"__loose": F.col("__opens"), "__any": F.when(F.col("__headings") > 0, F.lit(True))})
    each = placed.select(document, "page", "__carry", "__loose", "__any", F.explode("__pieces").alias("p"))
    top = F.get("p.lines", F.lit(0))
    each = each.select(
        document, "page", (F.col("__carry") + F.col("p.local")).alias("section"), "__loose", "__any", F.size("p.lines").alias("n"), top["no"].alias("line_no"), F.when(top["heading"], top["line"]).alias("heading"),
        F.array_join(F.transform("p.lines", block), "\n\n").alias("md"),
    )
    units = each.groupBy(document, "section").agg(
        F.max("heading").alias("heading"), F.first("__loose").alias("__loose"), F.first("__any").alias("__any"), F.min(F.struct("page", "line_no")).alias("first"), F.sum("n").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "md"))), lambda x: x["md"]), "\n\n").alias("markdown"),
    )
    pos = (F.col("section") + F.col("__loose").cast("int")).cast("int")
    return units.select(document, pos.alias("pos"), X.unit_id(pos).alias("unit_id"), F.coalesce("heading", F.lit("Document")).alias("title"), "first.page", "first.line_no", F.when(F.col("__any"), 0.8).otherwise(0.5).alias("confidence"), "n_lines", "markdown")


def section_warnings(units: DataFrame, document: str) -> DataFrame:
    """One ``ambiguous-structure`` warning for each document without headings."""
    return units.where("confidence = 0.5").select(document, F.lit("ambiguous-structure").alias("code"), F.lit("No reliable section headings were found; using one document unit.").alias("message"), "page")


def merge_title_pages(chapters: DataFrame, document: str, order: str, is_body: Column, is_empty: Column | None = None) -> DataFrame:
    """Runs of title-only chapters join the next body chapter; empty ones go first; trailing runs go.

    Needs ``markdown`` and ``path``.  The result has the body's columns, ``markdown`` of the whole run and ``paths`` of all.
    """
    rows = chapters if is_empty is None else chapters.where(~is_empty)
    rows = rows.withColumn("__body", is_body)
    rows = scan(rows, document, order, wide=("markdown",), before={"__run": F.col("__body").cast("int")})
    every = F.array_sort(F.collect_list(F.struct(order, "markdown", "path")))
    runs = rows.groupBy(document, "__run").agg(every.alias("__all"), F.first(F.when(F.col("__body"), F.struct(*[c for c in chapters.columns if c not in (document, "markdown")])), ignorenulls=True).alias("__own"))
    kept = runs.where(F.col("__own").isNotNull())
    out = {c: F.col(document) if c == document else F.array_join(F.transform("__all", lambda x: x["markdown"]), "\n\n").alias(c) if c == "markdown" else F.col("__own").getField(c).alias(c) for c in chapters.columns}
    return kept.select(*out.values(), F.transform("__all", lambda x: x["path"]).alias("paths"))


def dropped_units(chapters: DataFrame, document: str, order: str, is_body: Column) -> DataFrame:
    """Title-only chapters that no body chapter follows."""
    rows = chapters.withColumn("__body", is_body)
    last = rows.where("__body").groupBy(F.col(document).alias("__doc")).agg(F.max(order).alias("__last"))
    rows = rows.where("not __body").join(last, F.col(document).eqNullSafe(F.col("__doc")), "left")
    return rows.where(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).drop("__body", "__doc", "__last")


def check_parts(parts: list[int], count: int) -> list[int]:
    """Distinct part numbers for deletion; raises for numbers out of range, none, or all."""
    for p in parts:
        if not isinstance(p, int) or not 1 <= p <= count:
            raise ValidationError(f"Part number is out of range: {p}")
    chosen = sorted(set(parts))
    if not chosen:
        raise ValidationError("Specify at least one part to delete.")
    if len(chosen) >= count:
        raise ValidationError("At least one unit must remain.")
    return chosen


def delete_parts(units: DataFrame, gone: Column, document: str = "document_id") -> DataFrame:
    """Units without the ones marked ``gone``, numbered anew; ``old_id`` is the id before."""
    kept = units.where(~gone).withColumns({"old_id": F.col("unit_id"), "__old": F.col("pos")})
    return numbered(kept, document, "__old", wide=tuple(c for c in ("markdown",) if c in kept.columns)).drop("__old")


def concatenated(units: DataFrame, document: str = "document_id", rule: str = "\n\n---\n\n") -> DataFrame:
    """One Markdown text per document, units in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "markdown")))
    return units.groupBy(document).agg(F.array_join(F.transform(ordered, lambda x: x["markdown"]), rule).alias("markdown"), F.count("*").alias("n_units"))


def select_units(units: DataFrame, only: list[int] | None) -> DataFrame:
    """The wanted ordinals, filtered before any text is joined."""
    return units if only is None else units.where(F.col("pos").isin(sorted(set(only))))


def attach_backward(events: DataFrame, units: DataFrame, document: str, at: str, starts: str, unit: str) -> DataFrame:
    """Each event row gets the last unit that starts at or before it, else the first unit with ``low_confidence``.

    An as-of join by one scan: units and events in one ordered stream, the unit carried forward, also from part to part.
    """
    stream = units.select(document, F.col(starts).alias("__at"), F.lit(0).alias("__kind"), F.col(unit).alias("__unit"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name not in (document,)])
    asked = events.select(document, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(units.schema[unit].dataType).alias("__unit"), *[c for c in events.columns if c != document])
    both = scan(stream.unionByName(asked), document, "__at", "__kind", "__unit", last={"attached": F.col("__unit")}, first={"__first": F.col("__unit")})
    out = both.where("__kind = 1").withColumn("low_confidence", F.col("attached").isNull() & F.col("__first").isNotNull())
    return out.withColumn("attached", F.coalesce("attached", "__first")).drop("__at", "__kind", "__unit", "__first")
