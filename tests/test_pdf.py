from quire.functions.pdf_text import Pdf
from quire.functions.pdf_write import Writer, lay_out
from quire.sources import pdf as P

from .fixtures import pdf


def test_sections_titles_and_failures(spark):
    docs = {
        "one": pdf(["Chapter 1", "Hello world."]), "none": pdf(["just text (here)", "and \\ more"]), "two": pdf([["Intro line", "1. Alpha", "text"], ["-- 2 of 2 --", "BETA", "more"]], title="My Book", compress=True),
        "bad": b"not a pdf", "empty": pdf([" "]),
    }
    out = P.extract(spark.createDataFrame(list(docs.items()), "document_id string, content binary"))
    units = {}
    for r in out.units.orderBy("document_id", "pos").collect():
        units.setdefault(r.document_id, []).append(r)
    assert [(u.title, u.markdown, u.source.confidence) for u in units["one"]] == [("Chapter 1", "# Chapter 1\n\nHello world.", 0.8)]
    assert [(u.title, u.markdown, u.source.confidence) for u in units["none"]] == [("Document", "just text (here)\n\nand \\\\ more", 0.5)]
    assert [(u.title, u.source.page) for u in units["two"]] == [("Document", 1), ("1. Alpha", 1), ("BETA", 2)]
    assert {r.document_id: r.code for r in out.failures.collect()} == {"bad": "malformed-source", "empty": "missing-text"}
    assert {r.document_id: r.title for r in out.documents.collect()} == {"one": "one", "none": "none", "two": "My Book"}
    assert [(r.document_id, r.code) for r in out.warnings.collect()] == [("none", "ambiguous-structure")]


def test_written_files_can_be_read():
    w = Writer()
    lay_out(w, "<h1>Title</h1><p>" + "word " * 900 + "</p><ul><li>a</li></ul><table><tr><td>x</td><td>y</td></tr></table><pre>code (1)</pre>")
    p = Pdf(w.bytes("Doc"))
    text = "\n".join(p.page_text(x) for x in p.pages())
    assert len(p.pages()) == 2 and p.title() == "Doc" and text.startswith("Title\nword") and text.count("word") == 900
    assert "x | y" in text and "code (1)" in text and "\u2022 a" in text


def test_failures_are_handed_on_in_batches(spark):
    """Not one table a file: the rows of many small files go together."""
    rows = P.pages(spark.range(0, 3000, 1, 1).selectExpr("string(id) as document_id", "binary('x') as content"))
    assert "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString() and "MapInPandas" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.where("code = 'malformed-source'").count() == 3000
