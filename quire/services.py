"""The engine's services: extract, build, delete, translate, benchmark, and lookups that a server needs.

Services return data and never print.
"""

from __future__ import annotations

import json
import os
import re
import shutil
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .errors import EngineError, ValidationError
from .functions import html_tree as H
from .functions import text as X
from .functions.pdf_write import Writer, lay_out
from .operators import links as L
from .operators import manifest as M
from .operators import answers, models, translate
from .operators import render as R
from .operators import units as U
from .operators.stage import shared_path, staged
from .sources import cache, discovery, epub, pdf, project, project_sink


@dataclass
class ExtractResult:
    documents: DataFrame
    units: DataFrame
    assets: DataFrame
    warnings: DataFrame
    manifests: DataFrame
    failures: DataFrame
    skipped: DataFrame


def extract(spark: SparkSession, root: str, strict: bool = False) -> ExtractResult:
    """All sources below ``root``.  Failures are rows; with ``strict`` they raise after everything has run."""
    sources, skipped = discovery.discover(spark, root)
    discovery.check_collisions(sources)
    sources = sources.withColumnRenamed("document_name", "document_id")
    # signatures take the first bytes; whole files are read once, each by its own format's reader
    rows = staged(discovery.checked(discovery.contents(spark, root, sources, head=8)).drop("content"))
    bad = rows.where("error is not null").select("document_id", F.col("error.code").alias("code"), F.col("error.message").alias("message"))
    good = rows.where("error is null")
    parts = [reader.extract(discovery.contents(spark, root, good.where(F.col("format") == fmt).select("path", "document_id")).select("document_id", "content")) for fmt, reader in (("epub", epub), ("pdf", pdf))]
    both = lambda name: getattr(parts[0], name).unionByName(getattr(parts[1], name), allowMissingColumns=True)
    meta = both("documents").join(rows.select("document_id", "format", F.col("relative_path").alias("path"), "size"), "document_id")
    units, assets, warnings = staged(both("units")), staged(both("assets")), staged(both("warnings"))
    failures = staged(both("failures").unionByName(bad))
    if strict:
        found = failures.join(rows.select("document_id", "relative_path"), "document_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("relative_path", F.lit(": "), "message"))), "; ").alias("m")).first().m
        if found:
            raise EngineError("malformed-source", found)
    return ExtractResult(meta, units, assets, warnings, M.create(meta, units, assets), failures, skipped)


def extract_command(spark: SparkSession, root: str, source: str | None = None, document: str | None = None, force: bool = False) -> dict:
    """One file, or all below ``root/sources``, into projects below ``root/documents``; failures of a batch are listed."""
    library = os.path.join(root, "documents")
    if source is None:
        out = extract(spark, os.path.join(root, "sources"))
        done = save(out, library, force)
        return {"documents": done, "failures": [r.asDict() for r in out.failures.collect()], "skipped": [r.relative_path for r in out.skipped.collect()]}
    name = document or X.slug_exact(source)
    if not re.fullmatch("[a-z0-9]+(?:-[a-z0-9]+)*", name):
        raise ValidationError(f"Invalid document name: {name}")
    out = extract(spark, source)
    failed = out.failures.collect()
    if failed:
        raise EngineError(failed[0].code, failed[0].message)
    old = out.manifests.select("document_id").first()
    if old is None:
        raise EngineError("unsupported-structure", f"Unsupported source: {source}")
    renamed = lambda df: df.withColumn("document_id", F.lit(name))
    meta = renamed(out.documents).withColumn("path", F.lit(os.path.basename(source)))
    units, assets, warnings = renamed(out.units), renamed(out.assets), renamed(out.warnings)
    one = ExtractResult(meta, units, assets, warnings, M.create(meta, units, assets), out.failures, out.skipped)
    return {"documents": save(one, library, force), "failures": [], "skipped": []}


def extraction_json(result: ExtractResult) -> DataFrame:
    """(document_id, report): the machine-readable extraction report."""
    warned = result.warnings.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code", "message", "severity", "location"))), lambda w: F.struct(w["code"].alias("code"), w["message"].alias("message"), w["severity"].alias("severity"), w["location"].alias("location"))).alias("warnings"))
    n_units = result.units.groupBy("document_id").agg(F.count("*").alias("unitCount"))
    n_images = result.assets.groupBy("document_id").agg(F.count("*").alias("imageCount"))
    rows = result.documents.join(n_units, "document_id").join(n_images, "document_id", "left").join(warned, "document_id", "left")
    body = F.struct(F.struct("format", "path", "size").alias("source"), "unitCount", F.coalesce("imageCount", F.lit(0)).alias("imageCount"), F.coalesce("warnings", F.array().cast(warned.schema["warnings"].dataType)).alias("warnings"))
    return rows.select("document_id", F.to_json(body, {"pretty": "true"}).alias("report"))


def extraction_reports(result: ExtractResult) -> DataFrame:
    n_units = result.units.groupBy("document_id").agg(F.count("*").alias("n_units"))
    n_images = result.assets.groupBy("document_id").agg(F.count("*").alias("n_images"))
    docs = result.documents.join(n_units, "document_id").join(n_images, "document_id", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))
    return R.extraction_report(docs, result.warnings)


def save_projects(result: ExtractResult, library: str, force: bool = False) -> DataFrame:
    """Write every extracted project below ``library`` from tasks, each table read once; -> (document_id, units, images)."""
    named = lambda df, name: df.select("document_id", F.lit(name).alias("name"), F.col("report").alias("text"))
    told = extraction_json(result).withColumn("report", F.concat("report", F.lit("\n")))
    reports = named(extraction_reports(result), "extraction.md").unionByName(named(told, "extraction.json"))
    project_sink.write_projects(project_sink.project_files(result.manifests, result.units, result.assets, reports), library, force)
    counts = result.units.groupBy("document_id").agg(F.count("*").alias("units")).join(result.assets.groupBy("document_id").agg(F.count("*").alias("images")), "document_id", "left")
    return counts.join(result.manifests.select("document_id"), "document_id", "left_semi").select("document_id", "units", F.coalesce("images", F.lit(0)).alias("images"))


def save(result: ExtractResult, library: str, force: bool = False) -> dict[str, dict]:
    """``save_projects`` with its counts by document on the driver: for the command line."""
    return {r.document_id: {"units": r.units, "images": r.images} for r in save_projects(result, library, force).collect()}


@dataclass
class BuildResult:
    output: str
    format: str
    files: list[str]
    skipped_images: list[tuple[str, str, str]] = field(default_factory=list)


def build(spark: SparkSession, project_dir: str, output: str, fmt: str = "html") -> BuildResult:
    """A project as an HTML site or as one PDF file."""
    (row,) = project.load_manifests(spark, project_dir).collect()
    m = row.manifest
    units = project.load_units(spark, project_dir)
    with open(project.inside(project_dir, m.templates.base), encoding="utf-8") as f:
        base = f.read()
    if fmt == "html":
        os.makedirs(os.path.join(output, "chapters"), exist_ok=True)
        files = ["index.html", "print.css"]
        index = R.index_content(units, "document_id", F.lit(m.title), site=True)
        page = R.apply_template(base, {"title": F.lit(m.title), "language": F.lit(m.language), "direction": F.lit(m.direction), "homeHref": F.lit("index.html"), "stylesHref": F.lit("print.css"), "content": F.col("content")})
        project._put(os.path.join(output, "index.html"), index.select(page.alias("html")).first().html)
        for r in R.unit_pages(units, "document_id", F.lit(m.title), F.lit(m.language), base, site=True).toLocalIterator():
            files.append(f"chapters/{r.unit_id}.html")
            project._put(os.path.join(output, files[-1]), r.html)
        shutil.copyfile(project.inside(project_dir, m.templates.styles), os.path.join(output, "print.css"))
        assets = os.path.join(project_dir, "assets")
        for top, folders, names in os.walk(assets):
            for n in [*folders, *names]:
                if os.path.islink(os.path.join(top, n)):
                    raise ValidationError(f"Symbolic links are not supported: {n}")
        if os.path.isdir(assets):
            shutil.copytree(assets, os.path.join(output, "assets"), dirs_exist_ok=True)
        return BuildResult(output, fmt, sorted(files))
    if fmt != "pdf":
        raise ValidationError(f"Unknown format: {fmt}")
    from .operators.markdown import markdown_to_html

    body = markdown_to_html(R.strip_duplicate_title(F.col("markdown"), F.col("title")))
    rows = units.select("document_id", "pos", "title", "path", "markdown").unionByName(R.contents_row(units, "document_id").withColumn("path", F.lit("")))
    writer, skipped = Writer(), []
    for r in rows.select("pos", "title", "path", body.alias("html")).orderBy("pos").toLocalIterator():

        def picture(src: str):
            if re.match(r"(?i)(?:[a-z][a-z\d+.-]*:|//)", src) or src.lower().endswith(".svg"):
                return None
            path = os.path.normpath(os.path.join(project_dir, "chapters", src))
            if not path.startswith(os.path.abspath(project_dir) + os.sep) and not path.startswith(project_dir.rstrip("/") + os.sep):
                return None
            if not os.path.exists(path):
                return "Image file was not found"
            with open(path, "rb") as f:
                data = f.read()
            size = epub.image_size(data)
            return (data, *size) if data[:3] == b"\xff\xd8\xff" and size else "Image format cannot be embedded"

        writer.new_page()
        skipped += [(r.path, s, why) for s, why in lay_out(writer, f"<h1>{H.escape(r.title)}</h1>{r.html}", picture)]
    os.makedirs(output, exist_ok=True)
    name = f"{m.id}.pdf"
    project._put(os.path.join(output, name), writer.bytes(m.title))
    return BuildResult(output, fmt, [name], skipped)


@dataclass
class DeleteResult:
    project_dir: str
    removed_titles: list[str]
    remaining: int


def delete(spark: SparkSession, project_dir: str, parts: list[int]) -> DeleteResult:
    """Remove units, number the others anew, mend their links, drop assets that nothing uses; all or nothing."""
    (row,) = project.load_manifests(spark, project_dir).collect()
    m = row.manifest
    chosen = U.check_parts(parts, len(m.units))
    units = project.load_units(spark, project_dir)
    gone = F.col("pos").isin(chosen)
    kept = U.delete_parts(units, gone)
    ids = kept.select("document_id", F.col("old_id").alias("target"), F.col("unit_id").alias("new"))
    kept = L.remap_read_links(kept, ids).withColumn("path", X.unit_path(F.col("pos"), F.col("title")))
    refs = L.asset_references(kept)
    listed = spark.createDataFrame([(m.id, a.id, a.path, a.mimeType, a.altText, a.width, a.height) for a in m.assets], "document_id string, asset_id string, path string, mime_type string, alt_text string, width double, height double")
    assets = L.used_assets(listed, refs)
    rows = {a.path for a in assets.select("path").collect()}  # the assets of one document
    docs = spark.createDataFrame([(m.id, m.title, m.language, m.source.format, m.source.path, m.source.size)], "document_id string, title string, language string, format string, path string, size double")
    with_bytes = spark.createDataFrame([(m.id, p, _read(project_dir, p)) for p in sorted(rows)], "document_id string, path string, bytes binary")
    reports = {n: _read(project_dir, f"reports/{n}").decode() for n in _names(project_dir, "reports")}
    templates = _templates(project_dir)
    kept = staged(kept)
    project.write_project(project_dir, m.id, M.create(docs, kept, assets), kept, with_bytes, reports, force=True, templates=templates)
    return DeleteResult(project_dir, [m.units[p - 1].title for p in chosen], len(m.units) - len(chosen))


def _read(root: str, path: str) -> bytes:
    with open(project.inside(root, path), "rb") as f:
        return f.read()


def _names(root: str, folder: str) -> list[str]:
    path = os.path.join(root, folder)
    return sorted(n for n in os.listdir(path) if os.path.isfile(os.path.join(path, n))) if os.path.isdir(path) else []


def _templates(project_dir: str) -> dict[str, bytes]:
    return {n: _read(project_dir, f"templates/{n}") for n in _names(project_dir, "templates")}


def translate_project(spark: SparkSession, project_dir: str, to: str, cache_path: str | None, output: str | None = None, model: str = models.DEFAULT_MODEL, runner: translate.Runner = translate.echo_runner, only: list[int] | None = None, max_cost: float | None = None, concurrency: int = translate.DEFAULT_CONCURRENCY, best_effort: bool = False, force: bool = False, dry: bool = False, generated: str = "", report_path: str | None = None) -> dict:
    """A transformed sibling project; returns the run's summary.

    The cache is a table of its own and outlives outputs; without ``cache_path`` none is read or written.  ``report_path`` is
    absolute or seen from the output folder.
    """
    (row,) = project.load_manifests(spark, project_dir).collect()
    m, language = row.manifest, translate.language_tag(to)
    models.find(model)
    translate.check_concurrency(concurrency)
    only = translate.check_selection(only, len(m.units))
    name = os.path.basename(output) if output else translate.output_name(m.id, language)
    output = output or os.path.join(os.path.dirname(project_dir.rstrip("/")), name)
    if name == m.id:
        raise ValidationError("The output document must differ from the source document")
    units = staged(project.load_units(spark, project_dir))
    if dry:
        return translate.dry_run(U.select_units(units, only), model, language, m.language).first().asDict()
    if os.path.isdir(output) and os.listdir(output) and not force:
        raise ValidationError(f"Output project {output} already has content. Use force to replace it.")
    stored = cache.read(spark, cache_path) if cache_path else spark.createDataFrame([], cache.SEGMENTS)
    keys = translate.keyed(U.select_units(units, only), model, language)
    run = translate.translate(units, cache.newest(stored, keys), shared_path(spark, "ledger"), model, language, m.language, runner, only, max_cost, concurrency, best_effort)
    results = staged(run.results)
    if cache_path:
        cache.append(run.new, cache_path)
    summary = translate.run_summary(results).first().asDict()
    report = R.translation_report(results, summary, (m.id, m.language), (name, language), model, models.PROMPT_VERSION, generated)
    data = json.dumps({"promptVersion": models.PROMPT_VERSION, "generatedAt": generated, "model": model, "totals": summary, "units": [r.asDict(True) for r in results.drop("markdown").orderBy("pos").collect()]}, indent=2) + "\n"
    if summary["failed"] and not best_effort:
        project._put(os.path.join(output, "reports", "translation.md"), report)
        project._put(os.path.join(output, "reports", "translation.json"), data)
        if report_path:
            project._put(os.path.join(output, report_path), report)
        return summary | {"output": None}
    first = results.where("pos = 1").select(translate.document_title(results, F.lit(m.title)).alias("t")).first()
    new_units = translate.translated_manifest(units, results, ["unit_id"]).drop("markdown").join(results.select("unit_id", "markdown"), "unit_id")
    new_units = new_units.join(units.select("unit_id", F.col("markdown").alias("own")), "unit_id").withColumns({"document_id": F.lit(name), "markdown": F.coalesce("markdown", "own")}).drop("own")
    docs = spark.createDataFrame([(name, first.t, language, m.source.format, m.source.path, m.source.size)], "document_id string, title string, language string, format string, path string, size double")
    assets = spark.createDataFrame([(name, a.id, a.path, a.mimeType, a.altText, a.width, a.height, _read(project_dir, a.path)) for a in m.assets], "document_id string, asset_id string, path string, mime_type string, alt_text string, width double, height double, bytes binary")
    project.write_project(output, name, M.create(docs, new_units, assets), new_units, assets, {"translation.md": report, "translation.json": data}, force, _templates(project_dir))
    if report_path:
        project._put(os.path.join(output, report_path), report)
    return summary | {"output": output}


def benchmark(spark: SparkSession, units: DataFrame, chosen: list[str], to: str, source: str = "en", runner: translate.Runner = translate.echo_runner, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every chosen model over ``units(unit_id, pos, title, path, markdown)``: (rows, summary); rows of other models in ``previous`` stay."""
    out, empty = None, spark.createDataFrame([], schemas.CACHE)
    for model in chosen:
        run = translate.translate(units, empty, shared_path(spark, "ledger"), model, to, source, runner, concurrency=1)
        rows = answers.of_results(run.results)
        out = rows if out is None else out.unionByName(rows)
    out = staged(out)
    if previous is not None:
        out = translate.benchmark_merge(previous, out)
    known = models.table(spark)
    return translate.benchmark_order(out, known), translate.benchmark_summary(out, known)


def save_benchmark(rows: DataFrame, summary: DataFrame, folder: str, generated: str = "") -> None:
    """Answers as a table and as files by model, and the report for a reader's judgement; models that are not in ``rows`` stay as they are."""
    rows = staged(rows)  # they may come from the table that is replaced
    answers.store(rows, os.path.join(folder, "rows"))
    said = rows.where("markdown is not null").select(F.col("model").alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("path"), F.col("markdown").cast("binary").alias("content"))
    project_sink.write_projects(said, os.path.join(folder, answers.FOLDER), force=True)
    listed = {r.model: r.listed for r in answers.reviewed(rows).collect()}  # one row for each model
    project._put(os.path.join(folder, "benchmark.md"), R.benchmark_report(summary, rows.drop("markdown"), generated) + "".join(f"\n## Answers of {m}\n\n{listed[m]}\n" for m in sorted(listed)))


def load_benchmark(spark: SparkSession, folder: str) -> DataFrame | None:
    """Rows of earlier benchmarks with their answers, or None when there are none that can be read."""
    path = os.path.join(folder, "rows")
    try:
        spark.read.parquet(path)
    except Exception:
        return None
    return answers.load(spark, path)


def unit_by_id(units: DataFrame, unit_id: str) -> DataFrame:
    """The unit that a read route names; no rows when there is none."""
    return units.where(F.col("unit_id") == unit_id)


#: File types that a server may hand out.
SERVED = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}


def asset_type(path: str) -> str | None:
    return SERVED.get(os.path.splitext(path)[1].lower())
