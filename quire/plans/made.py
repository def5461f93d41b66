"""Queries over inputs made from the driver's tables, for operators whose own inputs are files or document models.

Conversations stand in for documents: every turn is a chapter, a page or a block.  The SQL states the rows that must come out.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..errors import ValidationError
from ..functions import text as X
from ..operators import compare, links, manifest
from ..operators import markdown as G
from ..operators import units as U
from ..operators.stage import shared_path, staged
from ..sources import discovery, epub, pdf, project_sink

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return keep


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, conv_id, turn, role, text, plain): ``plain`` has letters, digits and single spaces only."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    plain = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    return rows.select(F.format_string("conv-%d", "conv_id").alias("document_id"), "conv_id", "turn", "role", "text", plain.alias("plain"))


_SQL_TURNS = "t as (select printf('conv-%d', conv_id) as document_id, conv_id, turn, role, text, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) as plain, row_number() over (partition by conv_id order by turn) as pos from conversations)"


# -- files ------------------------------------------------------------------------------------------------------

_CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'


@F.pandas_udf(T.BinaryType())
def _archive(bodies: pd.Series) -> pd.Series:
    """An archive with a chapter per body, and a spine that also names an item whose file is missing."""

    def one(chapters):
        out = io.BytesIO()
        names = [f"c{i + 1}" for i in range(len(chapters))]
        items = "".join(f'<item id="{n}" href="text/{n}.xhtml"/>' for n in [*names, "gone"])
        refs = "".join(f'<itemref idref="{n}"/>' for n in [*names, "gone"])
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("mimetype", "application/epub+zip")
            z.writestr("META-INF/container.xml", _CONTAINER)
            z.writestr("OPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:language>en</dc:language></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
            for n, body in zip(names, chapters):
                z.writestr(f"OPS/text/{n}.xhtml", f"<html><head><title>x</title></head><body>{body}</body></html>")
        return out.getvalue()

    return bodies.map(one)


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    body = F.concat(F.format_string("<h1>Part %d of <em>it</em></h1><p>", "turn"), X.escape_html(F.col("plain")), F.lit(' &amp; <a href="c1.xhtml#top">first</a></p><ul><li>'), F.col("role"), F.lit("</li><li><b>end</b></li></ul><script>no</script>"))
    chapters = F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("body")))), lambda x: x["body"])
    return rows.groupBy("document_id").agg(chapters.alias("chapters")).select("document_id", _archive("chapters").alias("content"))


@_query(f"""with {_SQL_TURNS} select document_id, pos::int as pos, printf('unit-%03d', pos) as unit_id, printf('Part %d of it', turn) as title, printf('chapters/%03d-part-%d-of-it.md', pos, turn) as path,
  md5(printf('# Part %d of *it*', turn) || chr(10) || chr(10) || trim(plain || ' & [first](/read/unit-001#top)') || chr(10) || chr(10) || '- ' || role || chr(10) || '- **end**') as markdown_md5 from t""")
def epub_units(spark, sf_dir):
    units = epub.extract(_books(spark, sf_dir)).units
    return units.select("document_id", F.col("pos").cast("int").alias("pos"), "unit_id", "title", "path", F.md5("markdown").alias("markdown_md5"))


@_query(f"with {_SQL_TURNS} select document_id, 'unresolved-resource' as code, 'Spine item was not found: gone' as message, 1::bigint as n from t group by 1")
def epub_warnings(spark, sf_dir):
    found = epub.extract(_books(spark, sf_dir)).warnings
    return found.groupBy("document_id", "code", "message").agg(F.count("*").alias("n"))


@_query("select doc_id::varchar as document_id, 'malformed-source' as code, 'epub' as reader from documents union all select doc_id::varchar, 'malformed-source', 'pdf' from documents")
def source_failures(spark, sf_dir):
    """Texts that are no archives and no PDF files: a failure row each, and no other document is stopped."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), F.encode("text", "UTF-8").alias("content"))
    found = [reader.extract(rows).failures.select("document_id", "code", F.lit(name).alias("reader")) for reader, name in ((epub, "epub"), (pdf, "pdf"))]
    return found[0].unionByName(found[1])


@F.pandas_udf(T.BinaryType())
def _pages(lines: pd.Series) -> pd.Series:
    """A PDF file with a page per list of lines; the pages inherit their font from the page tree."""

    def one(pages):
        objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
        kids = []
        for page in pages:
            stream = ("BT /F1 12 Tf 72 720 Td " + " ".join(f"({x}) Tj 0 -16 Td" for x in page) + " ET").encode()
            objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
            objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(objects))
            kids.append(b"%d 0 R" % len(objects))
        objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(kids), b" ".join(kids))
        body, at = b"%PDF-1.4\n", []
        for i, x in enumerate(objects):
            at.append(len(body))
            body += b"%d 0 obj\n%s\nendobj\n" % (i + 1, x)
        table = b"".join(b"%010d 00000 n \n" % x for x in at)
        return body + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(body))

    return lines.map(one)


@_query(f"""with {_SQL_TURNS} select document_id, pos::int as pos, printf('Chapter %d', turn) as title, pos::int as page, 0.8::double as confidence,
  md5(printf('# Chapter %d', turn) || chr(10) || chr(10) || trim('said ' || plain)) as markdown_md5 from t""")
def pdf_units(spark, sf_dir):
    lines = F.array(F.format_string("Chapter %d", "turn"), F.concat(F.lit("said "), F.col("plain")))
    pages = F.transform(F.array_sort(F.collect_list(F.struct("turn", lines.alias("lines")))), lambda x: x["lines"])
    files = _turns(spark, sf_dir).groupBy("document_id").agg(pages.alias("pages")).select("document_id", _pages("pages").alias("content"))
    units = pdf.extract(files).units
    return units.select("document_id", F.col("pos").cast("int").alias("pos"), "title", F.col("source.page").alias("page"), F.col("source.confidence").alias("confidence"), F.md5("markdown").alias("markdown_md5"))


# -- models -----------------------------------------------------------------------------------------------------


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _markdown(level: Column) -> Column:
    """A text with every kind of block, over the column ``plain``."""
    words = F.concat(F.lit("w "), F.col("plain"))
    return _lines(
        F.concat(F.repeat(F.lit("#"), level), F.lit(" Head")), "", F.concat(words, F.lit(" [l](/read/unit-001) ![i](../assets/images/a.png)")), "", "1. one", "2. two", "", "| a | b |", "| --- | --- |", "| 1 | 2 |", "", "```ts", "code", "```", "", F.concat(F.lit("> "), words), "", "---",
    )


_SQL_BLOCKS = """(values (0, 'heading', null::boolean, null::int, null::int, null::int, null), (1, 'paragraph', null, null, null, null, null), (2, 'list', true, 2, null, null, null), (3, 'table', null, null, 2, 2, null),
  (4, 'code', null, null, null, null, 'ts'), (5, 'blockquote', null, null, null, null, null), (6, 'paragraph', null, null, null, null, null), (7, 'thematic-break', null, null, null, null, null)) as b(place, kind, ordered, item_count, n_rows, n_columns, language)"""


@_query(f"with {_SQL_TURNS} select document_id, turn, place, kind, case when kind = 'heading' then turn % 6 + 1 end::int as level, ordered, item_count, n_rows, n_columns, language from t cross join {_SQL_BLOCKS}")
def skeleton_blocks(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("s", G.skeleton(_markdown((F.col("turn") % 6 + 1).cast("int"))))
    rows = rows.select("document_id", "turn", F.posexplode("s.blocks").alias("place", "b"))
    return rows.select("document_id", "turn", "place", "b.kind", "b.level", "b.ordered", "b.item_count", F.col("b.rows").alias("n_rows"), F.col("b.columns").alias("n_columns"), "b.language")


#: (what changes, the kinds of the issues that must follow); the first changes nothing.
_CHANGES = (("", "", ""), ("(/read/unit-001)", "(/read/unit-002)", "link"), ("a.png", "b.png", "image"), ("Head", "", ""), ("2. two\n", "", "structure"), ("| 1 | 2 |\n", "", "structure"), ("```ts", "```js", "structure"), ("(/read/unit-001)", "(/read/unit-999)", "link,internal-link"), ("\n---", "", "structure"))


@_query(f"""with {_SQL_TURNS} select document_id, turn, kinds = '' as ok, kinds from t join (values {", ".join(f"({i}, '{k}')" for i, (_, _, k) in enumerate(_CHANGES))}) as c(n, kinds) on c.n = (conv_id + turn) % {len(_CHANGES)}""")
def structure_verdicts(spark, sf_dir):
    """Every turn against a version of itself with one change; the change goes by the turn's number."""
    rows = _turns(spark, sf_dir).select("document_id", "turn", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_CHANGES))).alias("n"), _markdown(F.lit(1)).alias("source"))
    changed = F.col("source")
    for i, (old, new, _) in enumerate(_CHANGES):
        if old:
            changed = F.when(F.col("n") == i, F.replace(F.col("source"), F.lit(old), F.lit(new))).otherwise(changed)
    pairs = rows.withColumn("translated", changed).drop("n").withColumns({"source_skeleton": G.skeleton("source"), "translated_skeleton": G.skeleton("translated")})
    found = compare.validate(pairs, spark.range(1, 101).select(X.unit_id(F.col("id")).alias("unit")), ["document_id", "turn"])
    return found.select("document_id", "turn", "ok", F.array_join(F.transform("issues", lambda x: x["kind"]), ",").alias("kinds"))


@_query(f"""with {_SQL_TURNS}, b as (select *, case when pos % 3 = 0 then '> ' || plain when pos % 3 = 1 then '## ' || plain else '1. ' || plain || chr(10) || '2. `' || role || '`' end as md from t)
select document_id, md5(string_agg(md, chr(10) || chr(10) order by pos)) as markdown_md5 from b group by 1""")
def document_model_markdown(spark, sf_dir):
    """Documents as JSON models, a block per turn, serialised."""
    units = U.numbered(_turns(spark, sf_dir), "document_id", "turn")
    children = F.array(F.struct(F.lit("text").alias("kind"), F.col("plain").alias("text")))
    paragraph = F.struct(F.lit("paragraph").alias("kind"), children.alias("children"))
    code = F.struct(F.lit("paragraph").alias("kind"), F.array(F.struct(F.lit("code").alias("kind"), F.col("role").alias("text"))).alias("children"))
    quote = F.to_json(F.struct(F.lit("blockquote").alias("kind"), F.array(paragraph).alias("blocks")))
    head = F.to_json(F.struct(F.lit("heading").alias("kind"), F.lit(2).alias("level"), children.alias("children")))
    items = F.to_json(F.struct(F.lit("list").alias("kind"), F.lit(True).alias("ordered"), F.array(F.struct(F.array(paragraph).alias("blocks")), F.struct(F.array(code).alias("blocks"))).alias("items")))
    block = F.when(F.col("pos") % 3 == 0, quote).when(F.col("pos") % 3 == 1, head).otherwise(items)
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), ",")
    rows = units.groupBy("document_id").agg(F.concat(F.lit("["), blocks, F.lit("]")).alias("blocks"))
    return rows.select("document_id", F.md5(G.unit_markdown(F.lit(None).cast("string"), F.col("blocks"))).alias("markdown_md5"))


# The rule that each kind of manifest breaks first; a document's kind goes by its number.
_BROKEN = ("", "id", "title", "language", "direction", "source.path", "source.size", "units.path", "units.id", "assets.path", "templates.base", "schemaVersion")


@_query(f"""select doc_id, field from (select doc_id, (doc_id % {len(_BROKEN)})::int as n from documents) join (values {", ".join(f"({i}, '{f}')" for i, f in enumerate(_BROKEN))}) as b(n, field) using (n) where field <> ''""")
def manifest_violations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "source", "lang", "n_chars", (F.col("doc_id") % len(_BROKEN)).alias("n"))
    bad = lambda field, wrong, right: F.when(F.col("n") == _BROKEN.index(field), wrong).otherwise(right)
    place = F.struct(F.lit("a.pdf").alias("sourcePath"))
    unit = lambda k: F.struct(bad("units.id", F.lit("unit-001"), F.lit(f"unit-00{k}")).alias("id"), F.lit("t").alias("title"), bad("units.path", F.lit(f"../{k}.md"), F.lit(f"chapters/{k}.md")).alias("path"), place.alias("source"))
    asset = F.struct(F.lit("a").alias("id"), bad("assets.path", F.lit("elsewhere/a.png"), F.lit("assets/images/a.png")).alias("path"), F.lit("image/png").alias("mimeType"))
    made = F.struct(
        bad("schemaVersion", F.lit(2), F.lit(1)).alias("schemaVersion"), bad("id", F.lit("Not Safe"), F.lower("source")).alias("id"), bad("title", F.lit(""), F.col("source")).alias("title"), bad("language", F.lit(""), F.col("lang")).alias("language"), bad("direction", F.lit("up"), X.direction(F.col("lang"))).alias("direction"),
        F.struct(F.lit("pdf").alias("format"), bad("source.path", F.lit("/a.pdf"), F.lit("sources/a.pdf")).alias("path"), bad("source.size", F.lit(-1), F.col("n_chars")).cast("double").alias("size")).alias("source"), F.array(unit(1), unit(2)).alias("units"), F.array(asset).alias("assets"),
        F.struct(bad("templates.base", F.lit("base.html"), F.lit("templates/base.html")).alias("base"), F.lit("templates/print.css").alias("styles")).alias("templates"),
    )
    parsed = rows.select("doc_id", F.from_json(F.to_json(made), schemas.schema(schemas.MANIFEST)).alias("manifest"))
    return manifest.violations(parsed, "doc_id").select("doc_id", "field")


@_query(f"""with {_SQL_TURNS}, k as (select *, row_number() over (partition by conv_id order by pos) as new from t where role <> 'system')
select k.document_id, printf('unit-%03d', k.new) as unit_id, md5(k.plain || ' [a](' || case when a.new is null then '#' else printf('/read/unit-%03d', a.new) || '#x' end || ') [b](' || case when b.new is null then '#' else printf('/read/unit-%03d', b.new) end || ')') as markdown_md5
from k left join k a on a.conv_id = k.conv_id and a.pos = 1 left join k b on b.conv_id = k.conv_id and b.pos = k.pos + 1""")
def read_links_remapped(spark, sf_dir):
    """Units that link the first and the next unit, after system turns are deleted and the rest is numbered anew."""
    units = U.numbered(_turns(spark, sf_dir), "document_id", "turn")
    text = F.concat(F.col("plain"), F.lit(" [a](/read/unit-001#x) [b](/read/"), X.unit_id(F.col("pos") + 1), F.lit(")"))
    kept = U.delete_parts(units.withColumn("markdown", text), F.col("role") == "system")
    ids = kept.select("document_id", F.col("old_id").alias("target"), F.col("unit_id").alias("new"))
    return links.remap_read_links(kept, ids).select("document_id", "unit_id", F.md5("markdown").alias("markdown_md5"))


# Links of a made page in the ways that HTML can write them, and the target that must come out (none for text that is no link).
_LINKS = (
    ('<a href="/q/{}">x</a>', "/q/{}"), ("<a href='/s/{}'>x</a>", "/s/{}"), ("<A\n HREF=/u/{} >x</A>", "/u/{}"), ('<!-- <a href="/no/{}"> -->', None), ("<script>'<a href=\"/no/{}\">'</script>", None),
    ('<a title="href=1" href = "/e/{}?a=1&amp;b=2">x</a>', "/e/{}?a=1&b=2"), ("<a data-href='/no/{}' href=''>x</a>", ""), ('<p title="<a href=">href="/no/{}"</p>', None), ('<a href="/1/{}" href="/2/{}">x</a>', "/1/{}"),
)


@_query(f"""select page_id, row_number() over (partition by page_id order by n)::int as link_no, href from (
  {" union all ".join(f"select page_id, {i} as n, replace('{out}', '{{}}', page_id::varchar) as href from pages" for i, (_, out) in enumerate(_LINKS) if out is not None)})""")
def made_link_targets(spark, sf_dir):
    """Links of pages that quote their targets in every way, with look-alikes in comments, scripts and attributes."""
    html = F.replace(F.lit("<body>" + " ".join(made for made, _ in _LINKS) + "</body>"), F.lit("{}"), F.col("page_id").cast("string"))
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", html.alias("html"))
    return links.html_targets(rows).select("page_id", "link_no", "href")


@_query(f"""with {_SQL_TURNS}, f as (
  select document_id, printf('chapters/%03d-%s.md', pos, case when role = '' then 'document' else role end) as path, md5(role || chr(10) || plain) as content_md5 from t
  union all select distinct document_id, unnest(['manifest.json', 'templates/base.html', 'templates/print.css', 'reports/note.txt']), null from t
) select * from f""")
def project_folders(spark, sf_dir):
    """Conversations as project folders, written by tasks, written again over themselves, and read back from the files."""
    library = shared_path(spark, "projects")
    if not library.startswith(("file:", "/")):
        raise ValidationError("project folders need a file system that driver and tasks share")
    units = U.numbered(_turns(spark, sf_dir), "document_id", "turn", wide=("text", "plain"))
    place = F.struct(F.lit("a").alias("source_path"), *[F.lit(None).cast(t).alias(c) for c, t in (("page", "int"), ("spine_index", "int"), ("selector", "string"), ("confidence", "double"))])
    units = staged(units.select("document_id", "pos", "unit_id", F.col("role").alias("title"), X.unit_path(F.col("pos"), F.col("role")).alias("path"), place.alias("source"), F.concat_ws("\n", "role", "plain").alias("markdown")))
    ids = units.select("document_id").distinct()
    documents = ids.select("document_id", F.col("document_id").alias("title"), F.lit("en").alias("language"), F.lit("epub").alias("format"), F.lit("a.epub").alias("path"), F.lit(1).alias("size"))
    assets = spark.createDataFrame([], "document_id string, asset_id string, path string, bytes binary, mime_type string, alt_text string, width double, height double")
    files = project_sink.project_files(manifest.create(documents, units, assets), units, assets, ids.select("document_id", F.lit("note.txt").alias("name"), F.lit("x").alias("text")))
    folder = library.removeprefix("file://")
    project_sink.write_projects(files, folder)
    project_sink.write_projects(files, folder, force=True)
    found = project_sink.read_projects(spark, folder)
    return found.select("document_id", "path", F.when(F.col("path").startswith("chapters/"), F.md5("content")).alias("content_md5"))


# Names of files below a conversation's folder, and what a listing makes of each; {} is the turn.
_TREE = (("{}/A b.EPUB", "epub", "a-b"), ("{}/_under.pdf", "pdf", "under"), ("{}/.hidden/x.epub", "epub", "x"), ("{}/notes.txt", None, None), ("{}/no suffix", None, None), ("{}/_SUCCESS", None, None), ("{}/deep/er/é%20.Pdf", "pdf", "e-20"))


@_query(f"""with {_SQL_TURNS} select document_id || '/' || replace(name, '{{}}', turn::varchar) as relative_path, format, slug as document_name, length(plain)::bigint as size
from t cross join (values {", ".join(f"('{n}', {'null' if f is None else repr(f)}, {'null' if s is None else repr(s)})" for n, f, s in _TREE)}) as v(name, format, slug)""")
def discovered_sources(spark, sf_dir):
    """Sources and skipped files of a tree of folders with hidden names, written by tasks and listed level by level."""
    library = shared_path(spark, "sources")
    if not library.startswith(("file:", "/")):
        raise ValidationError("folders of files need a file system that driver and tasks share")
    names = F.explode(F.array(*[F.lit(n) for n, _, _ in _TREE]))
    files = _turns(spark, sf_dir).select("document_id", "turn", "plain", names.alias("name"))
    project_sink.write_projects(files.select("document_id", F.replace("name", F.lit("{}"), F.col("turn").cast("string")).alias("path"), F.col("plain").cast("binary").alias("content")), library.removeprefix("file://"), force=True)
    sources, skipped = discovery.discover(spark, library)
    rows = sources.select("relative_path", "format", "document_name").unionByName(skipped, allowMissingColumns=True)
    sizes = files.select(F.concat_ws("/", "document_id", F.replace("name", F.lit("{}"), F.col("turn").cast("string"))).alias("relative_path"), F.length("plain").cast("long").alias("size"))
    return rows.join(sizes, "relative_path", "left")


# -- scalars ----------------------------------------------------------------------------------------------------


@_query(r"""select doc_id, case doc_id % 6 when 0 then 'png' when 1 then 'jpeg' when 2 then 'gif' when 3 then 'webp' end as format, doc_id % 6 < 2 as embeddable,
  case doc_id % 4 when 0 then 'OPS/images/' || doc_id || '.png' when 1 then 'images/' || doc_id || '.png' when 3 then 'OPS/text/a b.png' end as resolved,
  case doc_id % 3 when 0 then 'Inner ' || doc_id when 1 then 'x ' || chr(96) || chr(96) || chr(96) else 'plain' end as stripped, doc_id % 4 as kind from documents""")
def bytes_and_paths(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id")
    pick = lambda n, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.col("doc_id") % n + 1).cast("int"))
    head = F.unhex(pick(6, "89504E470D0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "5249464600000000", "00"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    href = pick(4, F.concat(F.lit("../images/"), name), F.concat(F.lit("../../images/"), name, F.lit("#f")), F.lit("../../../x.png"), F.lit("./a%20b.png"))
    fenced = pick(3, F.concat(F.lit("\n```md\nInner "), F.col("doc_id").cast("string"), F.lit("\n```  ")), F.lit("x ```"), F.lit("plain"))
    fmt = X.image_format(head)
    return rows.select("doc_id", fmt.alias("format"), F.coalesce(X.is_embeddable(fmt), F.lit(False)).alias("embeddable"), X.resolve_archive_path(F.lit("OPS/text"), href).alias("resolved"), X.strip_outer_fence(fenced).alias("stripped"), (F.col("doc_id") % 4).alias("kind"))


@_query(f"""with {_SQL_TURNS} select document_id, turn, pos % 3 = 0 as is_empty, pos % 3 = 1 as is_title_only, case when pos % 3 = 1 then 'Only ' || role when pos % 3 = 0 then 'Untitled' else 'Head ' || role end as title,
  case when pos % 3 = 1 then 'Only ' || role when pos % 3 = 2 then 'Head ' || role end as heading from t""")
def chapter_kinds(spark, sf_dir):
    units = U.numbered(_turns(spark, sf_dir), "document_id", "turn")
    own = F.when(F.col("pos") % 3 == 0, F.lit("![](a.png)\n")).when(F.col("pos") % 3 == 1, F.concat(F.lit("# **Only** "), F.col("role"), F.lit("\n"))).otherwise(F.concat(F.lit("## Head "), F.col("role"), F.lit(" ##\n\nw "), F.col("plain")))
    md = units.withColumn("md", own)
    return md.select("document_id", "turn", X.is_empty_chapter(F.col("md")).alias("is_empty"), X.is_title_only(F.col("md")).alias("is_title_only"), X.derive_title(F.col("md")).alias("title"), G.first_heading("md").alias("heading"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
