"""Command line: ``python -m quire extract|build|delete|translate|show``.  It maps options to services and prints results."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .errors import EngineError, ValidationError
from .operators import models, translate


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("--root", default=".", help="folder with sources/ and documents/")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract", help="extract PDF and EPUB files into documents/")
    x.add_argument("--input", help="one source file")
    x.add_argument("--document", help="name of its project")
    x.add_argument("--all", action="store_true", help="every source below sources/")
    x.add_argument("--force", action="store_true")
    b = sub.add_parser("build", help="make an HTML site or a PDF file of a document")
    b.add_argument("--document", required=True)
    b.add_argument("--format", required=True, choices=("html", "pdf"))
    b.add_argument("--out", default="generated")
    d = sub.add_parser("delete", help="remove units and number the others anew")
    d.add_argument("--document", required=True)
    d.add_argument("--parts", required=True, nargs="+", type=int)
    t = sub.add_parser("translate", help="transform a document with a model")
    t.add_argument("--document", required=True)
    t.add_argument("--to", required=True)
    t.add_argument("--model", default=models.DEFAULT_MODEL)
    t.add_argument("--out-document")
    t.add_argument("--concurrency", type=int, default=translate.DEFAULT_CONCURRENCY)
    t.add_argument("--only", nargs="+", type=int)
    t.add_argument("--force", action="store_true")
    t.add_argument("--dry-run", action="store_true")
    t.add_argument("--no-cache", dest="cache", action="store_false")
    t.add_argument("--best-effort", action="store_true")
    t.add_argument("--max-cost", type=float)
    t.add_argument("--report")
    t.add_argument("--json", action="store_true")
    s = sub.add_parser("show", help="print one unit of a document")
    s.add_argument("--document", required=True)
    s.add_argument("--unit", required=True)
    return p


def run(spark, argv: list[str], runner: translate.Runner = translate.echo_runner, generated: str = "") -> dict:
    """Run one command; returns what it would print."""
    from . import services

    o = parser().parse_args(argv)
    docs = os.path.join(o.root, "documents")
    if o.command == "extract":
        if bool(o.input) == bool(o.all):
            raise ValidationError("Give exactly one of --input and --all.")
        return services.extract_command(spark, o.root, o.input, o.document, o.force)
    project = os.path.join(docs, o.document)
    if o.command == "build":
        out = services.build(spark, project, o.out if os.path.isabs(o.out) else os.path.join(project, o.out), o.format)
        return {"output": out.output, "files": out.files, "skipped_images": out.skipped_images}
    if o.command == "delete":
        out = services.delete(spark, project, o.parts)
        return {"removed": out.removed_titles, "remaining": out.remaining}
    if o.command == "show":
        from .sources.project import load_units

        found = services.unit_by_id(load_units(spark, project), o.unit).collect()
        if not found:
            raise EngineError("unit-not-found", f"Unit was not found: {o.unit}")
        return {"unit": found[0].unit_id, "title": found[0].title, "markdown": found[0].markdown}
    if o.max_cost is not None and o.max_cost < 0:
        raise ValidationError("--max-cost must be a number of 0 or more")
    cache = "file://" + os.path.abspath(os.path.join(docs, ".cache", o.document)) if o.cache else None
    output = os.path.join(docs, o.out_document) if o.out_document else None
    out = services.translate_project(spark, project, o.to, cache, output, o.model, runner, o.only, o.max_cost, o.concurrency, o.best_effort, o.force, o.dry_run, generated, o.report)
    return out | {"exit": 1 if out.get("failed") else 0}


def main() -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quire").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        import datetime

        out = run(spark, sys.argv[1:], generated=datetime.datetime.now(datetime.timezone.utc).isoformat())
    except EngineError as error:
        print(f"{error.code}: {error.message}", file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return int(out.get("exit", 0))
