import pytest

from quire.sources import epub as E

from .fixtures import epub, png

BODY = '<h1>One</h1><p>a <em>b</em></p><img src="../images/figure-1.png" alt="Fig"/><ul><li>x</li><li>y</li></ul><table><tr><th>h</th></tr><tr><td>1</td></tr></table>'


@pytest.fixture(scope="module")
def extracted(spark):
    docs = {
        "plain": epub([BODY], {"images/figure-1.png": png(40, 40)}),
        "missing": epub([BODY]),
        "linked": epub(['<h1>A</h1><p><a href="chapter-2.xhtml#top">Next chapter</a> <a href="gone.xhtml">x</a> <a href="http://e.org/">out</a></p>', '<h1 id="top">B</h1><p>text</p>']),
        "decor": epub(['<h1>A</h1><p><img src="../images/dot.png" alt=""/> one</p><p><img src="../images/dot.png" alt=""/> two</p>'], {"images/dot.png": png()}),
        "spine": epub(["", '<img src="../images/c.png" alt="cover"/>', "<h1>Part I</h1>", "<h2>Chapter 1. Real</h2><p>Body text.</p>", "<p>one two three four five six seven eight nine ten eleven</p>", "<h1>Trailing</h1>"], {"images/c.png": png(50, 50)}),
        "fonts": epub([BODY], {"images/figure-1.png": png(40, 40)}, encryption="fonts/font.ttf"),
        "locked": epub([BODY], encryption="OEBPS/text/chapter-1.xhtml"),
        "badref": epub(["<h1>A</h1><p>x</p>"], spine=["nope", "chapter-1"]),
        "broken": b"not a zip",
    }
    out = E.extract(spark.createDataFrame(list(docs.items()), "document_id string, content binary"))
    return {
        "units": {}, "u": out.units.orderBy("document_id", "pos").collect(), "a": out.assets.collect(), "w": out.warnings.collect(),
        "f": {r.document_id: r.code for r in out.failures.collect()}, "d": {r.document_id: r for r in out.documents.collect()},
    }


def units(x, name):
    return [r for r in x["u"] if r.document_id == name]


def codes(x, name):
    return sorted(r.code for r in x["w"] if r.document_id == name)


def test_default_book(extracted):
    (u,) = units(extracted, "plain")
    assert extracted["d"]["plain"].title == "Fixture Book" and extracted["d"]["plain"].language == "en"
    assert u.title == "One" and u.unit_id == "unit-001" and u.path == "chapters/001-one.md" and u.source.spine_index == 0
    assert "![Fig](../assets/images/figure-1.png)" in u.markdown and "- x\n- y" in u.markdown and "| h |" in u.markdown
    (a,) = [a for a in extracted["a"] if a.document_id == "plain"]
    assert (a.asset_id, a.path, a.mime_type, a.alt_text, a.width) == ("asset-001", "assets/images/figure-1.png", "image/png", "Fig", 40.0)


def test_missing_image_is_a_warning_and_leaves_no_link(extracted):
    assert codes(extracted, "missing") == ["unresolved-resource"] and "![" not in units(extracted, "missing")[0].markdown


def test_links_between_chapters(extracted):
    md = units(extracted, "linked")[0].markdown
    assert "[Next chapter](/read/unit-002#top)" in md and "[x](#)" in md and "[out](http://e.org/)" in md
    assert codes(extracted, "linked") == ["unresolved-resource"]


def test_small_repeated_images_are_decoration(extracted):
    assert codes(extracted, "decor") == ["decorative-image"] and "![" not in units(extracted, "decor")[0].markdown
    assert not [a for a in extracted["a"] if a.document_id == "decor"]


def test_title_pages_merge_and_empty_or_trailing_ones_go(extracted):
    a, b = units(extracted, "spine")
    assert a.title == "Chapter 1. Real" and a.markdown.startswith("# Part I\n\n## Chapter 1. Real") and a.path == "chapters/001-chapter-1.md"
    assert b.title == "one two three four five six seven eight nine ten"
    assert not [x for x in extracted["a"] if x.document_id == "spine"]


def test_encryption(extracted):
    assert codes(extracted, "fonts") == ["unsupported-structure"] and units(extracted, "fonts")
    assert extracted["f"]["locked"] == "encrypted-source" and not units(extracted, "locked")


def test_bad_spine_items_and_archives_do_not_stop_others(extracted):
    assert codes(extracted, "badref") == ["unresolved-resource"] and len(units(extracted, "badref")) == 1
    assert extracted["f"] == {"locked": "encrypted-source", "broken": "malformed-source"}


def test_archives_are_parsed_once(spark):
    """Failures and entries come from the written rows of one pass; an archive that breaks in its middle gives a failure and no entries."""
    good = epub([BODY])
    at = good.index(b"chapter-1.xhtml") + 40
    cut = good[:at] + bytes(x ^ 1 for x in good[at : at + 8]) + good[at + 8 :]
    every, bad = E.entries(spark.createDataFrame([("good", good), ("cut", cut), ("none", None)], "document_id string, content binary"))
    for rows in (every, bad):
        assert "MapIn" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.document_id for r in bad.collect()) == ["cut", "none"] and {r.document_id for r in every.collect()} == {"good"}
