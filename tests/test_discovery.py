import os

import pytest
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as X
from quire.operators import markdown as G
from quire.sources import discovery


def put(root, *names):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        with open(f"{root}/{n}", "w") as f:
            f.write(n)


def test_every_entry_is_a_source_or_skipped(spark, tmp_path):
    root = str(tmp_path / "s")
    put(root, "b.epub", "_c.PDF", ".d/e.epub", "f.txt", "noext", "deep/a/b/c/My Book.epub", "x%20y.pdf", "k.epub/z.pdf")
    os.makedirs(f"{root}/empty")
    os.mkfifo(f"{root}/pipe.pdf")
    os.symlink(f"{root}/b.epub", f"{root}/link.epub")
    os.symlink(f"{root}/deep", f"{root}/loop")
    sources, skipped = discovery.discover(spark, root)
    got = {r.relative_path: (r.format, r.document_name, r.size) for r in sources.collect()}
    assert got == {n: (f, d, len(n)) for n, f, d in (("b.epub", "epub", "b"), ("_c.PDF", "pdf", "c"), (".d/e.epub", "epub", "e"), ("deep/a/b/c/My Book.epub", "epub", "my-book"), ("x%20y.pdf", "pdf", "x-20y"), ("k.epub/z.pdf", "pdf", "z"))}
    assert sorted(r.relative_path for r in skipped.collect()) == ["f.txt", "link.epub", "loop", "noext", "pipe.pdf"]
    read = {r.relative_path: bytes(r.content) for r in discovery.contents(spark, root, sources).collect()}
    assert read == {n: n.encode() for n in got}


def test_folders_that_cannot_be_read(spark, tmp_path):
    put(str(tmp_path), "a/x.pdf")
    rows = discovery._listed([(str(tmp_path / "a"), "a"), (str(tmp_path / "gone"), "gone")])
    assert [(r[1], r[2]) for r in rows] == [("a/x.pdf", "file"), ("gone", "unreadable")]
    with pytest.raises(EngineError) as e:
        discovery.discover(spark, str(tmp_path / "gone"))
    assert e.value.code == "validation-error"
    sources, _ = discovery.discover(spark, str(tmp_path))
    os.remove(tmp_path / "a/x.pdf")
    row = discovery.checked(discovery.contents(spark, str(tmp_path), sources)).first()
    assert row.content is None and row.error.code == "malformed-source" and "Unable to read the file" in row.error.message


def test_locale_order(spark, tmp_path):
    names = ["Zebra.pdf", "apple.pdf", "Äpfel.pdf", "Apple.pdf", "zebra 2.pdf", "éclair.pdf", "eclair.pdf", "10.pdf"]
    put(str(tmp_path), *names)
    got = [r.relative_path for r in discovery.discover(spark, str(tmp_path))[0].collect()]
    assert got == ["10.pdf", "Äpfel.pdf", "apple.pdf", "Apple.pdf", "eclair.pdf", "éclair.pdf", "zebra 2.pdf", "Zebra.pdf"]


def test_a_single_file_is_a_root(spark, tmp_path):
    put(str(tmp_path), "One Book.epub")
    sources, skipped = discovery.discover(spark, str(tmp_path / "One Book.epub"))
    assert [(r.relative_path, r.document_name) for r in sources.collect()] == [("One Book.epub", "one-book")] and skipped.count() == 0


def test_code_without_a_language_says_so(spark):
    block = "struct<kind:string,level:int,ordered:boolean,item_count:int,rows:int,columns:int,language:string>"
    rows = spark.createDataFrame([(("code", None, None, None, None, None, None),), (("code", None, None, None, None, None, "py"),), (("heading", 2, None, None, None, None, None),), (None,)], f"b {block}")
    assert [r.t for r in rows.select(X.describe_block(F.col("b")).alias("t")).collect()] == ['{"kind":"code","language":null}', '{"kind":"code","language":"py"}', '{"kind":"heading","level":2}', "nothing (end of document)"]


def test_images_of_blocks_are_resolved(spark):
    blocks = '[{"kind": "paragraph", "children": [{"kind": "image", "asset_id": "asset-001", "alt": "A"}]}]'
    rows = spark.createDataFrame([(None, blocks, {"asset-001": "assets/images/a.png"}), ("own", blocks, None), (None, blocks, None), (None, None, {})], "m string, b string, a map<string,string>")
    plain = G.serialize_blocks(__import__("json").loads(blocks), {"asset-001": "assets/images/a.png"})
    got = [r.t for r in rows.select(G.unit_markdown(F.col("m"), F.col("b"), F.col("a")).alias("t")).collect()]
    assert got[0] == plain and "assets/images/a.png" in plain and got[1] == "own" and got[2] != plain and got[3] is None
