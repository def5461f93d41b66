import json
import os

import pytest

from quire import services as S
from quire.errors import EngineError, ValidationError
from quire.operators import translate
from quire.streaming import watch

from .fixtures import epub, pdf, png

BODY = ['<h1>One</h1><p>See <a href="chapter-3.xhtml">three</a>.</p><img src="../images/a.png" alt="A"/>', "<h1>Two</h1><p>x</p>", "<h1>Three</h1><p>y</p>"]


@pytest.fixture()
def library(spark, tmp_path):
    src = tmp_path / "sources"
    src.mkdir()
    (src / "My Book.epub").write_bytes(epub(BODY, {"images/a.png": png(30, 30)}, title="Three Parts"))
    (src / "paper.pdf").write_bytes(pdf(["Chapter 1", "Hello world."]))
    (src / "notes.txt").write_text("x")
    (src / "bad.epub").write_bytes(b"PK broken")
    (src / "wrong.pdf").write_bytes(b"hello")
    return tmp_path


def test_extract_build_delete_translate(spark, library):
    out = S.extract(spark, str(library / "sources"))
    assert sorted((r.document_id, r.code) for r in out.failures.collect()) == [("bad", "malformed-source"), ("wrong", "malformed-source")]
    assert [r.relative_path for r in out.skipped.collect()] == ["notes.txt"]
    counts = S.save(out, str(library / "docs"))
    assert counts == {"my-book": {"units": 3, "images": 1}, "paper": {"units": 1, "images": 0}}
    book = str(library / "docs" / "my-book")
    m = json.load(open(f"{book}/manifest.json"))
    assert m["title"] == "Three Parts" and [u["id"] for u in m["units"]] == ["unit-001", "unit-002", "unit-003"] and m["assets"][0]["path"] == "assets/images/a.png"
    assert "- Images: 1" in open(f"{book}/reports/extraction.md").read()
    with pytest.raises(ValidationError):
        S.save(out, str(library / "docs"))
    with pytest.raises(EngineError):
        S.extract(spark, str(library / "sources"), strict=True)

    site = S.build(spark, book, str(library / "site"))
    page = (library / "site/chapters/unit-001.html").read_text()
    assert site.files[:2] == ["chapters/unit-001.html", "chapters/unit-002.html"] and 'href="unit-003.html"' in page and "<h1 id=\"unit-title\">One</h1>" in page and page.count("<h1") == 1
    assert "3 units" in (library / "site/index.html").read_text() and (library / "site/assets/images/a.png").exists()
    assert S.build(spark, book, str(library / "pdf"), "pdf").skipped_images[0][2] == "Image format cannot be embedded"
    assert (library / "pdf/my-book.pdf").read_bytes().startswith(b"%PDF-")

    cache = f"file://{library}/cache"
    dry = S.translate_project(spark, book, "fr", cache, dry=True)
    assert dry["units"] == 3 and dry["cost_usd"] > 0
    first = S.translate_project(spark, book, "FR", cache)
    assert (first["translated"], first["cached"], first["failed"]) == (3, 0, 0) and first["output"].endswith("my-book-fr")
    again = S.translate_project(spark, book, "fr", cache, force=True)
    assert (again["translated"], again["cached"], again["cost_usd"]) == (0, 3, 0)
    one = S.translate_project(spark, book, "de", cache, only=[2])
    assert (one["translated"], one["skipped"]) == (1, 2)

    def broken(entry, system, user, markdown):
        return translate.echo_runner(entry, system, user, markdown) | {"text": markdown + "\n\nextra", "finish_reason": "stop"}

    strict = S.translate_project(spark, book, "es", cache, runner=broken)
    assert strict["failed"] == 3 and strict["output"] is None and strict["cost_usd"] > 0 and "Structure check failed" in open(f"{book}-es/reports/translation.md").read()
    soft = S.translate_project(spark, book, "es", cache, runner=broken, best_effort=True, force=True)
    assert soft["failed"] == 3 and soft["output"]

    with open(f"{book}/templates/print.css", "w") as f:
        f.write("own styles")
    gone = S.delete(spark, book, [2])
    assert open(f"{book}/templates/print.css").read() == "own styles" and open(f"{book}/reports/extraction.md").read()
    assert gone.removed_titles == ["Two"] and gone.remaining == 2
    m = json.load(open(f"{book}/manifest.json"))
    assert [u["path"] for u in m["units"]] == ["chapters/001-one.md", "chapters/002-three.md"]
    assert "(/read/unit-002)" in open(f"{book}/chapters/001-one.md").read()
    S.delete(spark, book, [1])
    assert json.load(open(f"{book}/manifest.json"))["assets"] == [] and not os.path.exists(f"{book}/assets/images/a.png")
    for parts in ([], [5], [1]):
        with pytest.raises(ValidationError):
            S.delete(spark, book, parts)


def test_name_collisions_stop_the_batch(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.pdf").write_bytes(pdf(["text"]))
    with pytest.raises(EngineError) as e:
        S.extract(spark, str(tmp_path))
    assert e.value.code == "name-collision"


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(pdf(["Chapter 1", "Hello."]))
    stream = watch.sources(spark, str(tmp_path / "in"))
    watch.extract_into(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.title for r in spark.read.parquet(str(tmp_path / "out/units")).collect()] == ["Chapter 1"]


def test_names_of_earlier_batches(spark, tmp_path):
    """A name belongs to the file that had it first, also across micro-batches; assets and warnings are written too."""
    def put(name, data):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)

    def run():
        watch.extract_into(watch.sources(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        read = lambda name: spark.read.option("mergeSchema", True).parquet(str(tmp_path / "out" / name))
        return sorted((r.batch, r.document_id) for r in read("units").select("batch", "document_id").distinct().collect()), sorted((r.batch, r.document_id, r.code) for r in read("failures").collect())

    put("a.pdf", pdf(["Chapter 1", "Hello."]))
    put("book.epub", epub(BODY, {"images/a.png": png(30, 30)}))
    put("x/b.pdf", pdf(["one"]))
    put("y/b.pdf", pdf(["two"]))
    units, failures = run()
    assert units == [(0, "a"), (0, "book")] and failures == [(0, "b", "name-collision")] * 2
    put("z/a.pdf", pdf(["other"]))
    put("c.pdf", pdf(["new"]))
    put("z/b.pdf", pdf(["first of its name, the others had none"]))
    units, failures = run()
    assert units == [(0, "a"), (0, "book"), (1, "b"), (1, "c")] and failures == [(0, "b", "name-collision")] * 2 + [(1, "a", "name-collision")]
    (message,) = [r.message for r in spark.read.parquet(str(tmp_path / "out/failures")).where("document_id = 'a'").collect()]
    assert message.count(".pdf") == 2
    assert spark.read.parquet(str(tmp_path / "out/assets")).select("path", "batch").collect() == [("assets/images/a.png", 0)]
    assert {r.code for r in spark.read.parquet(str(tmp_path / "out/warnings")).where("batch = 1").collect()} == {"ambiguous-structure"}
