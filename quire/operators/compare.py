"""Structural comparison of a text and its transformed version, from skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .stage import staged

#: Differences of blocks that are listed before the rest is left out.
LISTED = 5
LENGTH_BAND = (0.4, 2.5)


def positional_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows ``(keys, pos, expected, actual)`` where the arrays ``value`` of both sides differ; a missing end counts as null."""
    a = left.select(*keys, F.posexplode(value).alias("pos", "expected"))
    b = right.select(*keys, F.posexplode(value).alias("pos", "actual"))
    both = a.join(b, [*keys, "pos"], "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual"))).withColumn("pos", F.col("pos") + 1)


def array_diff(expected: Column, actual: Column) -> Column:
    """``(pos, expected, actual)`` of the places where two arrays of a row differ, in order; a missing end counts as null."""
    both = F.zip_with(expected, actual, lambda a, b: F.struct(a.alias("expected"), b.alias("actual")))
    placed = F.transform(both, lambda x, i: F.struct((i + 1).alias("pos"), x["expected"].alias("expected"), x["actual"].alias("actual")))
    return F.filter(placed, lambda x: ~x["expected"].eqNullSafe(x["actual"]))


def _issue(kind: str, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), message.alias("message"))


def block_issues(diff: Column) -> Column:
    """The first five block differences and a closing one if there are five or more."""
    said = lambda x: F.concat(F.lit("Block "), x["pos"].cast("string"), F.lit(" changed. Expected "), X.describe_block(x["expected"]), F.lit(" but found "), X.describe_block(x["actual"]), F.lit("."))
    listed = F.transform(F.slice(diff, 1, LISTED), lambda x: _issue("structure", said(x)))
    more = F.array(_issue("structure", F.lit("More structural differences were omitted.")))
    return F.when(F.size(diff) >= LISTED, F.concat(listed, more)).otherwise(listed)


def target_issues(diff: Column, kind: str, label: str) -> Column:
    either = lambda c: F.coalesce(c, F.lit("nothing"))
    said = lambda x: F.concat(F.lit(f"{label} "), x["pos"].cast("string"), F.lit(' changed. Expected "'), either(x["expected"]), F.lit('" but found "'), either(x["actual"]), F.lit('".'))
    return F.transform(diff, lambda x: _issue(kind, said(x)))


def internal_link_issues(links: DataFrame, unit_ids: DataFrame, keys: list[str]) -> DataFrame:
    """``links(keys, n, href)`` that name a unit which ``unit_ids(unit)`` lacks."""
    named = links.withColumn("unit", F.regexp_extract("href", r"/read/(unit-[a-z0-9-]+)", 1)).where("unit <> ''")
    by = [c for c in unit_ids.columns]
    bad = named.join(unit_ids, by, "left_anti")
    message = F.concat(F.lit('Internal link "'), F.col("href"), F.lit('" points to unknown unit "'), F.col("unit"), F.lit('".'))
    return bad.select(*keys, "n", _issue("internal-link", message).alias("issue"))


def length_ratio(source: Column, translated: Column) -> Column:
    return X.utf16_length(translated) / F.greatest(X.utf16_length(source), F.lit(1))


def length_warning(source: Column, translated: Column, band: tuple[float, float] = LENGTH_BAND) -> Column:
    """A warning text when the length ratio leaves the band, else null."""
    ratio = length_ratio(source, translated)
    text = F.format_string(f"Translated length ratio is %.2f and leaves the band {band[0]:g} to {band[1]:g}.", ratio)
    return F.when((ratio < band[0]) | (ratio > band[1]), text)


def validate(pairs: DataFrame, unit_ids: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs(keys, source, translated, source_skeleton, translated_skeleton)`` -> (keys, ok, issues, warning).

    Issues keep the order blocks, links, images, internal links.  Pairs with equal skeletons leave by one comparison; the others
    are compared inside their row.  Only links to units meet another table.  What is found is written once, for skeletons come from a
    parser and the links are read apart; texts and skeletons are not written.
    """
    part = lambda side, c: F.coalesce(F.col(f"{side}_skeleton.{c}"), F.array().cast(pairs.schema["source_skeleton"].dataType[c].dataType))
    diff = lambda c: array_diff(part("source", c), part("translated", c))
    found = F.concat(block_issues(diff("blocks")), target_issues(diff("links"), "link", "Link target"), target_issues(diff("images"), "image", "Image source"))
    none = F.array().cast("array<struct<kind:string,message:string>>")
    named = F.filter(F.transform(part("translated", "links"), lambda x, i: F.struct(i.alias("n"), x.alias("href"))), lambda x: F.contains(x["href"], F.lit("/read/unit-")))
    issues = F.when(F.col("source_skeleton").eqNullSafe(F.col("translated_skeleton")), none).otherwise(found)
    judged = staged(pairs.select(*keys, length_warning(F.col("source"), F.col("translated")).alias("warning"), issues.alias("issues"), named.alias("__named")))
    links = judged.where(F.size("__named") > 0).select(*keys, F.inline("__named"))
    lost = internal_link_issues(links, unit_ids, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "issue"))), lambda x: x["issue"]).alias("lost"))
    out = judged.drop("__named").join(lost, keys, "left").withColumn("issues", F.concat("issues", F.coalesce("lost", none)))
    return out.select(*keys, "warning", "issues", (F.size("issues") == 0).alias("ok"))
