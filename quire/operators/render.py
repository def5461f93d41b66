"""Rendering: index and unit pages, navigation, templates and reports, as Columns and aggregates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import units as U

PLACEHOLDERS = ("title", "language", "direction", "homeHref", "stylesHref", "content")
#: A small page of our own; any text with the placeholders will do.
BASE = (
    '<!DOCTYPE html>\n<html lang="{{language}}" dir="{{direction}}">\n<head>\n<meta charset="utf-8" />\n<meta name="viewport" content="width=device-width, initial-scale=1" />\n'
    '<title>{{title}}</title>\n<link rel="stylesheet" href="{{stylesHref}}" />\n</head>\n<body>\n<main>\n{{content}}\n</main>\n</body>\n</html>\n'
)
STYLES = "body { margin: 0 auto; max-width: 42rem; padding: 1rem; font: 1rem/1.6 serif }\nimg { max-width: 100% }\ntable { border-collapse: collapse }\ntd, th { border: 1px solid; padding: 0.25rem }\n"


def apply_template(template: str, values: dict[str, Column]) -> Column:
    """``template`` with its placeholders filled in one pass, so values that look like placeholders stay as they are."""
    parts = re.split("{{(" + "|".join(PLACEHOLDERS) + ")}}", template)
    out = [F.lit(p) if i % 2 == 0 else values["content"] if p == "content" else X.escape_html(values[p]) for i, p in enumerate(parts)]
    return F.concat(*out)


@F.pandas_udf(T.StringType())
def _encoded(s: pd.Series) -> pd.Series:
    from urllib.parse import quote

    return s.map(lambda x: None if x is None else quote(x, safe="!'()*~"), na_action="ignore")


def unit_href(unit_id: Column, site: bool = False) -> Column:
    """Link of a unit: a read route, or a file of the built site.  Ids are safe names, so nothing needs escapes."""
    return F.concat(F.lit("chapters/"), unit_id, F.lit(".html")) if site else F.concat(F.lit("/read/"), unit_id)


def unit_link(unit_id: Column, title: Column, site: bool = False) -> Column:
    return F.concat(F.lit('<li><a href="'), X.escape_html(unit_href(unit_id, site)), F.lit('">'), X.escape_html(title), F.lit("</a></li>"))


#: Units of a piece of a contents page.
PIECE = 1000


def index_pieces(units: DataFrame, document: str, site: bool = False) -> DataFrame:
    """(document, piece, n_units, list): the entries of each contents page, ``PIECE`` units at a time; no group is larger."""
    rows = F.array_sort(F.collect_list(F.struct("pos", unit_link(F.col("unit_id"), F.col("title"), site).alias("li"))))
    piece = F.floor((F.col("pos") - 1) / PIECE).cast("int").alias("piece")
    return units.groupBy(document, piece).agg(F.count("*").alias("n_units"), F.array_join(F.transform(rows, lambda x: x["li"]), "").alias("list"))


def index_content(units: DataFrame, document: str, title: Column, site: bool = False) -> DataFrame:
    """(document, n_units, content): the contents page of each document, put together from its ``index_pieces``."""
    rows = F.array_sort(F.collect_list(F.struct("piece", "list")))
    out = index_pieces(units, document, site).groupBy(document).agg(F.sum("n_units").alias("n_units"), F.array_join(F.transform(rows, lambda x: x["list"]), "").alias("list"))
    n = F.col("n_units").cast("string")
    head = F.concat(F.lit('<nav aria-labelledby="document-title"><h1 id="document-title">'), X.escape_html(title), F.lit("</h1><p>"), n, F.lit(" unit"), F.when(F.col("n_units") == 1, "").otherwise("s"), F.lit("</p><ol>"))
    return out.select(document, "n_units", F.concat(head, F.col("list"), F.lit("</ol></nav>")).alias("content"))


def contents_row(units: DataFrame, document: str) -> DataFrame:
    """A contents unit at position 0 for every document of more than one unit."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), F.col("title")).alias("t"))))
    return units.groupBy(document).agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("markdown")).where("n > 1").select(document, F.lit(0).alias("pos"), F.lit("Contents").alias("title"), "markdown")


def navigation(prev_id: Column, next_id: Column, home: str = "/", site: bool = False) -> Column:
    side = lambda unit, rel, label: F.coalesce(F.concat(F.lit(f'<a rel="{rel}" href="'), X.escape_html(F.concat(F.lit("../"), unit_href(unit, True)) if site else unit_href(unit)), F.lit(f'">{label}</a>')), F.lit(""))
    return F.concat(F.lit('<nav class="unit-navigation" aria-label="Unit navigation"><span>'), side(prev_id, "prev", "Previous"), F.lit('</span><a href="'), X.escape_html(F.lit(home)), F.lit('">Contents</a><span>'), side(next_id, "next", "Next"), F.lit("</span></nav>"))


def strip_duplicate_title(markdown: Column, title: Column) -> Column:
    """The text without the first leading heading that equals the title, and without blank lines after it."""
    lines = F.split(markdown, "\n")
    heading = r"^#{1,6}[ \t]+(.+?)[ \t]*$"
    kind = F.transform(lines, lambda x: F.when(X.trim_js(x) == "", 0).when(X.trim_js(x).rlike(heading), F.when(X.plain_title(F.regexp_extract(X.trim_js(x), heading, 1)) == title, 2).otherwise(1)).otherwise(3))
    stop = F.coalesce(F.nullif(F.array_position(kind, 3), F.lit(0)), F.size(lines).cast("long") + 1)
    at = F.array_position(kind, 2)
    rest = F.slice(lines, (at + 1).cast("int"), F.size(lines))
    keep = F.slice(kind, (at + 1).cast("int"), F.size(lines))
    skip = F.aggregate(keep, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, k: F.struct((a["n"] + F.when(a["go"] & (k == 0), 1).otherwise(0)).alias("n"), (a["go"] & (k == 0)).alias("go")))["n"]
    cut = F.concat(F.slice(lines, F.lit(1), F.greatest((at - 1).cast("int"), F.lit(0))), F.slice(rest, skip + 1, F.size(lines)))
    # only a text whose first line with words may be a heading has its lines looked at
    led = markdown.rlike(rf"^[{X.WS}]*#")
    return F.when(led, F.when((at > 0) & (at < stop), F.array_join(cut, "\n")).otherwise(markdown)).otherwise(markdown)


def rewrite_read_links(html: Column, prefix: str = "", suffix: str = ".html") -> Column:
    """``/read/<unit>`` links of rendered HTML for the layout of a built site."""
    return F.regexp_replace(html, r'href="/read/([^"#?]+)([#?][^"]*)?"', f'href="{prefix}$1{suffix}$2"')


def unit_pages(units: DataFrame, document: str, document_title: Column, language: Column, template: str = BASE, site: bool = False) -> DataFrame:
    """(document, unit_id, html) of every unit: title, body, navigation, template."""
    from .markdown import markdown_to_html

    home, styles = ("../index.html", "../print.css") if site else ("/", "/styles.css")
    rows = (units if "next_id" in units.columns else U.navigation(units, document, wide=("markdown",))).withColumn("__body", strip_duplicate_title(F.col("markdown"), F.col("title")))
    rows = rows.withColumn("__body", markdown_to_html(F.col("__body")))
    body = rewrite_read_links(F.col("__body")) if site else F.col("__body")
    content = F.concat(F.lit('<article aria-labelledby="unit-title"><h1 id="unit-title">'), X.escape_html(F.col("title")), F.lit("</h1>"), body, navigation(F.col("prev_id"), F.col("next_id"), home, site), F.lit("</article>"))
    page = apply_template(template, {"title": F.concat(F.col("title"), F.lit(" — "), document_title), "language": language, "direction": X.direction(language), "homeHref": F.lit(home), "stylesHref": F.lit(styles), "content": content})
    return rows.select(document, "unit_id", "pos", page.alias("html"))


def extraction_report(documents: DataFrame, warnings: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, report): Markdown report of ``documents(document, path, format, size, n_units, n_images)``."""
    line = F.concat(F.lit("- **"), F.col("code"), F.lit("** at "), X.format_location(F.col("location")), F.lit(": "), F.col("message"))
    listed = warnings.groupBy(document).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    out = documents.join(listed, document, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    head = F.concat_ws("\n", F.lit("# Extraction report"), F.lit(""), text("- Source: `", F.col("path"), "`"), text("- Format: `", F.col("format"), "`"), text("- Size: ", F.col("size"), " bytes"), text("- Markdown units: ", F.col("n_units")), text("- Images: ", F.col("n_images")), text("- Warnings: ", F.col("n")), F.lit(""))
    tail = F.when(F.col("n") == 0, "No extraction warnings were recorded.").otherwise(F.concat(F.lit("## Warnings\n\n"), F.col("lines")))
    return out.select(document, F.concat(head, F.lit("\n"), tail, F.lit("\n")).alias("report"))


def translation_report(results: DataFrame, summary: dict, source: tuple[str, str], target: tuple[str, str], model: str, version: str, generated: str) -> str:
    """Markdown report of one run: summary, one line per unit, warnings and failures where there are any.

    The rows of one document's units come to the driver, where the report is written.
    """
    usd, sec = (lambda v: f"{v:.4f}"), (lambda ms: f"{ms / 1000:.2f}")
    rows = results.drop("markdown", "translated_title").orderBy("pos").collect()
    out = ["# Translation report", "", f"- Source: `{source[0]}` (`{source[1]}`)", f"- Target: `{target[0]}` (`{target[1]}`)", f"- Model: `{model}`", f"- Prompt version: `{version}`", f"- Generated: {generated}", "", "## Summary", ""]
    table = [("Metric", "Value"), ("---", "---"), ("Units", len(rows)), *[(k.capitalize(), summary[k]) for k in ("translated", "cached", "failed", "skipped")], ("Input tokens", summary["input_tokens"]), ("Output tokens", summary["output_tokens"]), ("Wall clock (s)", sec(summary.get("wall_clock_ms", 0))), ("Unit time (s)", sec(summary["duration_ms"])), ("Cost (USD)", usd(summary["cost_usd"]))]
    out += [f"| {a} | {b} |" for a, b in table]
    out += ["", "## Units", "", "| Unit | Title | Status | Model | Duration (s) | Input tok | Output tok | Cost (USD) |", "| " + " | ".join(["---"] * 8) + " |"]
    for r in rows:
        cells = (f"`{r.unit_id}`", r.unit_title, r.status, f"`{r.model}`", sec(r.duration_ms), r.usage.no_cache + r.usage.cache_read, r.usage.output, usd(r.cost_usd))
        out.append("| " + " | ".join(map(str, cells)) + " |")
    for title, lines in (("Warnings", [f"- `{r.unit_id}`: {w}" for r in rows for w in r.warnings]), ("Failures", [f"- `{r.unit_id}`: {r.error or 'Unknown error'}" for r in rows if r.status == "failed"])):
        if lines:
            out += ["", f"## {title}", "", *lines]
    return "\n".join(out) + "\n"


def benchmark_report(summary: DataFrame, rows: DataFrame, generated: str) -> str:
    """Markdown report of a benchmark: one line per model, one per run, and empty columns for a reader's judgement."""
    usd, sec = (lambda v: f"{v:.4f}"), (lambda ms: f"{ms / 1000:.2f}")
    out = ["# Model benchmark", "", f"- Generated: {generated}", "", "## Summary", "", "| Model | Units | Time (s) | Cost (USD) | Failed | Quality | Verdict |", "| " + " | ".join(["---"] * 7) + " |"]
    out += [f"| `{r.model}` | {r.units} | {sec(r.duration_ms)} | {usd(r.cost_usd)} | {r.failed} |  |  |" for r in summary.orderBy("model_order", "model").collect()]
    out += ["", "## Runs", "", "| Model | Unit | Time (s) | Cost (USD) | Structure |", "| " + " | ".join(["---"] * 5) + " |"]
    out += [f"| `{r.model}` | `{r.unit_id}` | {sec(r.duration_ms)} | {usd(r.cost_usd)} | {'ok' if r.ok else 'failed'} |" for r in rows.orderBy("model_order", "unit_id").collect()]
    return "\n".join(out) + "\n"
