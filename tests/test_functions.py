import datetime

import pytest
from pyspark.sql import functions as F

from quire.errors import ValidationError
from quire.functions import html_tree as H
from quire.functions import markdown_html as MD
from quire.functions import text as X
from quire.operators import compare, links, manifest, models, translate
from quire.operators import markdown as G
from quire.operators import render as R
from quire.operators import units as U


def each(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_names(spark):
    values = ["Don't Make Me Think (1984).epub", "a/b/Éléphant ß.pdf", "Chapter 9. Usability testing", "---", ".hidden", "x.tar.gz", "ﬁn"]
    want = ["don-t-make-me-think-1984", "elephant", "chapter-9", "document", "hidden", "x-tar", "fin"]
    assert [X.slug_exact(v) for v in values] == want
    assert each(spark, X.slug, values[:-1]) == want[:-1]
    assert [r[0] for r in spark.range(1).select(X.unit_id(F.lit(7))).collect()] == ["unit-007"]
    assert spark.range(1).select(X.unit_path(F.lit(1234), F.lit("A b"))).first()[0] == "chapters/1234-a-b.md"


def test_headings(spark):
    lines = ["Chapter 1", "chapters", "1. Alpha", "1.2) Beta", "1 gamma", "ALL CAPS", "123", "Prologue: x", "x" * 101, "", "INTRODUCTION " + "A" * 90, "Straße"]
    assert each(spark, X.is_heading_line, lines) == [True, False, True, True, False, True, False, True, False, False, False, False]
    assert each(spark, X.is_page_marker, ["-- 1 of 20 --", "--1 OF 2--", "- 1 of 2 -"]) == [True, True, False]


def test_markdown_text(spark):
    md = "# T *a* `b`\n\n> quote [l](x) ![i](y)\n\n- item\n1. one\n\n```\ncode\n```\n tail end"
    assert each(spark, X.readable_text, [md]) == ["T a quote l item one tail end"]
    assert each(spark, X.derive_title, [md, "plain words here", "", "## ![x](y)\n\nbody", "### no\n\n1 2 3 4 5 6 7 8 9 10 11"]) == ["T a b", "plain words here", "Untitled", "body", "no 1 2 3 4 5 6 7 8 9"]
    assert each(spark, X.is_title_only, ["# a", "# a\n\nb", "b", "# a\n\n![x](y)"]) == [True, False, False, True]
    assert each(spark, X.is_empty_chapter, ["", "![x](y)", "# a", "b"]) == [True, True, False, False]
    assert each(spark, X.strip_outer_fence, ["```md\na\n```", " ```\na\nb\n``` ", "a ```b```", "  x "]) == ["a", "a\nb", "a ```b```", "  x "]
    assert each(spark, X.escape_html, ["<a href='x'>&\"</a>", "&amp;"]) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;", "&amp;amp;"]


def test_paths_and_links(spark):
    base = lambda b: lambda c: X.resolve_archive_path(F.lit(b), c)
    assert each(spark, base("OEBPS/text"), ["../images/a%20b+c.png#x", "./c.xhtml", "../../../x", "%ZZ", "d//e"]) == ["OEBPS/images/a b+c.png", "OEBPS/text/c.xhtml", None, None, "OEBPS/text/d/e"]
    assert each(spark, base("."), ["a/../b", ".."]) == ["b", None]
    assert each(spark, X.is_safe_href, ["", "#a", "http://x", "javascript:1", "//x", "/read/unit-001", "a/../b", "a"]) == [True, True, True, False, False, True, False, True]
    assert each(spark, X.is_safe_image_source, ["../assets/images/a.png", "assets/images/../x", "assets/images/", "http://x/assets/images/a", "a.png"]) == [True, False, False, False, False]
    assert each(spark, lambda c: X.is_inside_root("/a/b", c), ["/a/b", "/a/b/c", "/a/bc", "/a/b/../c"]) == [True, True, False, False]
    assert each(spark, X.direction, ["ar", "he-IL", "en", "arx"]) == ["rtl", "rtl", "ltr", "ltr"]
    assert each(spark, X.language_name, ["fr-CA", "xx", "EN"]) == ["French", "xx", "English"]


def test_bytes(spark):
    heads = [b"\x89PNG....", b"\xff\xd8\xff\xe0", b"GIF89a", b"RIFF....WEBP", b"RIFF....WAVE", b"", b"xx"]
    assert each(spark, X.image_format, [bytearray(b) for b in heads], "binary") == ["png", "jpeg", "gif", "webp", None, None, None]
    texts = [b"\xef\xbb\xbfa", "é".encode("utf-16"), b"\xfe\xff\x00a", b"bad \xff"]
    assert each(spark, X.decode_text, [bytearray(b) for b in texts], "binary") == ["a", "é", "a", "bad �"]
    assert each(spark, lambda c: X.utf16_length(c).cast("int"), ["a😀", ""]) == [3, 0]


def test_costs():
    m = models.find("gpt-6-luna")
    assert (m["price_in"], m["price_out"], m["price_cached"]) == (0.1, 0.5, 0.01)
    assert [x[3] for x in models.MODELS] == sorted(x[3] for x in models.MODELS)
    with pytest.raises(ValidationError):
        models.find("nope")


def test_cost_rounding(spark):
    cost = X.estimate_cost(F.lit(35), F.lit(0), F.lit(0), F.lit(0.1), F.lit(None).cast("double"), F.lit(0.5))
    assert spark.range(1).select(cost).first()[0] == 4e-6
    cached = X.estimate_cost(F.lit(0), F.lit(10**6), F.lit(0), F.lit(0.1), F.lit(0.01), F.lit(0.5))
    assert spark.range(1).select(cached).first()[0] == 0.01


def test_checks():
    assert translate.language_tag(" fr-CA ") == "fr-ca" and translate.output_name("a", "FR") == "a-fr"
    for bad in ("", "f", "fr_CA"):
        with pytest.raises(ValidationError):
            translate.language_tag(bad)
    assert translate.check_selection([3, 1, 3], 3) == [1, 3] and U.check_parts([2, 2], 3) == [2]
    for call in (lambda: translate.check_selection([4], 3), lambda: translate.check_concurrency(17), lambda: U.check_parts([1, 2, 3], 3)):
        with pytest.raises(ValidationError):
            call()


def test_retries():
    class Busy(Exception):
        status_code = 429

    tries, waits = [], []

    def action():
        tries.append(1)
        if len(tries) < 3:
            raise Busy
        return {"ok": 1}

    assert translate.with_retry(action, wait=waits.append) == {"ok": 1} and waits == [0.2, 0.4]
    with pytest.raises(ValueError):
        translate.with_retry(lambda: (_ for _ in ()).throw(ValueError()), wait=waits.append)


SOURCE = "# Title\n\nText [a](/read/unit-002) ![i](../assets/images/a.png)\n\n- x\n- y\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n\n```ts\nlet a\n```\n\n> quote\n\n---"


def test_skeleton():
    s = H.skeleton(MD.to_html(SOURCE))
    assert [b["kind"] for b in s["blocks"]] == ["heading", "paragraph", "list", "table", "code", "blockquote", "paragraph", "thematic-break"]
    assert s["blocks"][3]["rows"] == 3 and s["blocks"][3]["columns"] == 2 and s["blocks"][4]["language"] == "ts" and s["blocks"][2]["item_count"] == 2
    assert s["links"] == ["/read/unit-002"] and s["images"] == ["../assets/images/a.png"]


@pytest.mark.parametrize(
    ("old", "new", "kinds"),
    [("Title", "Titre", []), ("# Title", "## Title", ["structure"]), ("/read/unit-002", "/read/unit-009", ["link", "internal-link"]), ("a.png", "b.png", ["image"]), ("- y\n", "", ["structure"]), ("| 3 | 4 |\n", "", ["structure"]), ("```ts", "```js", ["structure"])],
)
def test_validation(spark, old, new, kinds):
    pairs = spark.createDataFrame([("u", SOURCE, SOURCE.replace(old, new))], "unit_id string, source string, translated string")
    pairs = pairs.withColumns({"source_skeleton": G.skeleton("source"), "translated_skeleton": G.skeleton("translated")})
    ids = spark.createDataFrame([("unit-001",), ("unit-002",)], "unit string")
    (r,) = compare.validate(pairs, ids, ["unit_id"]).collect()
    assert r.ok == (not kinds) and [i.kind for i in r.issues] == kinds and r.warning is None


def test_long_translations_warn_and_listing_stops_at_five(spark):
    pairs = spark.createDataFrame([("a", "x", "x" * 400), ("b", "\n\n".join("abcdefgh"), "# t")], "unit_id string, source string, translated string")
    pairs = pairs.withColumns({"source_skeleton": G.skeleton("source"), "translated_skeleton": G.skeleton("translated")})
    out = {r.unit_id: r for r in compare.validate(pairs, spark.createDataFrame([], "unit string"), ["unit_id"]).collect()}
    assert out["a"].ok and out["a"].warning == "Translated length ratio is 400.00 and leaves the band 0.4 to 2.5."
    assert len(out["b"].issues) == 6 and out["b"].issues[5].message == "More structural differences were omitted."


def test_links_are_rewritten_in_place(spark):
    units = spark.createDataFrame([("d", "unit-001", "a (/read/unit-001#x) b (/read/unit-003) c"), ("d", "unit-002", None)], "document_id string, unit_id string, markdown string")
    ids = spark.createDataFrame([("d", "unit-001", "unit-009")], "document_id string, target string, new string")
    out = {r.unit_id: r.markdown for r in links.remap_read_links(units, ids).collect()}
    assert out == {"unit-001": "a (/read/unit-009#x) b (#) c", "unit-002": ""}


def test_duplicate_titles(spark):
    md = ["# T\n\nbody", "# Part\n\n## T\n\n\nbody", "body\n\n# T", "# **T** \n", "# Other\n\nx", "", "# [T](x)\ny"]
    got = each(spark, lambda c: R.strip_duplicate_title(c, F.lit("T")), md)
    assert got == ["body", "# Part\n\nbody", "body\n\n# T", "", "# Other\n\nx", "", "y"]


def test_templates_fill_in_one_pass(spark):
    out = R.apply_template("<{{title}}|{{content}}|{{other}}>", {"title": F.lit("{{content}} & x"), "content": F.lit("<b>")})
    assert spark.range(1).select(out).first()[0] == "<{{content}} &amp; x|<b>|{{other}}>"


def test_sanitiser():
    clean = H.sanitize('<p onclick="x">a <b>b</b></p><script>s</script><a href="javascript:1">l</a><img src="http://x/y.png"/><img src="../assets/images/a.png" alt="A"/><table><tr><td colspan="2" style="x">c</td></tr></table>')
    assert clean == '<p>a b</p><a href="#" rel="noreferrer noopener">l</a><img src="../assets/images/a.png" alt="A" /><table><tr><td colspan="2">c</td></tr></table>'


def test_html_to_markdown():
    assert H.to_markdown("<h1>Hi</h1><p>a <em>b</em> and <strong>c</strong></p>") == "# Hi\n\na *b* and **c**"
    assert H.to_markdown("<p>x<p>y<br>z<ol><li>a<li>b</ol>") == "x\n\ny\nz\n\n1. a\n2. b"
    assert H.to_markdown(None) == "" and H.to_markdown("<script>var t='</p>';</script><p>k</p>") == "k"


def test_serialiser():
    blocks = [
        {"kind": "heading", "level": 2, "children": [{"kind": "text", "text": "a*b"}]},
        {"kind": "list", "ordered": True, "items": [{"blocks": [{"kind": "paragraph", "children": [{"kind": "code", "text": "x"}]}, {"kind": "code", "language": None, "text": "y"}]}]},
        {"kind": "blockquote", "blocks": [{"kind": "paragraph", "children": [{"kind": "link", "href": "h", "children": [{"kind": "emphasis", "style": "strong", "children": [{"kind": "text", "text": "t"}]}]}]}]},
        {"kind": "table", "headers": ["h"], "rows": [["1"]]}, {"kind": "thematic-break"}, {"kind": "paragraph", "children": [{"kind": "image", "asset_id": "asset-001", "alt": None, "title": 'q"'}]},
    ]
    assert G.serialize_blocks(blocks, {"asset-001": "assets/images/z.png"}) == '## a\\*b\n\n1. `x`\n   \n   ```\n   y\n   ```\n\n> [**t**](h)\n\n| h |\n| --- |\n| 1 |\n\n---\n\n![](../assets/images/z.png "q\\"")'


def test_manifest_rules(spark):
    good = {"schemaVersion": 1, "id": "doc", "title": "T", "language": "en", "direction": "ltr", "source": {"format": "pdf", "path": "sources/a.pdf", "size": 1.0}, "units": [{"id": "unit-001", "title": "a", "path": "chapters/001-a.md", "source": {"sourcePath": "x"}}], "assets": [], "templates": {"base": "templates/base.html", "styles": "templates/print.css"}}
    changes = [
        {}, {"schemaVersion": 2}, {"id": "Bad Name"}, {"direction": "up"}, {"units": []}, {"units": good["units"] * 2}, {"units": [good["units"][0] | {"path": "../x.md"}]}, {"units": [good["units"][0] | {"id": "Unit 1"}]},
        {"assets": [{"id": "a", "path": "assets/images/a.png", "mimeType": "image/png"}] * 2}, {"assets": [{"id": "a", "path": "assets/x.png", "mimeType": "image/png"}]}, {"source": good["source"] | {"size": -1.0}}, {"templates": {"base": "x", "styles": "templates/a"}},
    ]
    import json

    from quire import schemas

    rows = spark.createDataFrame([(i, json.dumps(good | c)) for i, c in enumerate(changes)], "document_id int, j string").select("document_id", F.from_json("j", schemas.schema(schemas.MANIFEST)).alias("manifest"))
    got = {}
    for r in manifest.violations(rows).orderBy("rule_no").collect():
        got.setdefault(r.document_id, []).append(r.field)
    assert got == {1: ["schemaVersion"], 2: ["id"], 3: ["direction"], 4: ["units"], 5: ["units.id", "units.path"], 6: ["units.path"], 7: ["units.id"], 8: ["assets.id", "assets.path"], 9: ["assets.path"], 10: ["source.size"], 11: ["templates.base"]}


def test_attach_backward_takes_the_last_unit_at_or_before(spark):
    units = spark.createDataFrame([("d", 2, "a"), ("d", 5, "b"), ("d", 5, "c")], "doc string, page int, unit string")
    events = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("d", 5, "z"), ("d", 9, "w"), ("e", 1, "v")], "doc string, page int, name string")
    got = {r.name: (r.attached, r.low_confidence) for r in U.attach_backward(events, units, "doc", "page", "page", "unit").collect()}
    assert got == {"x": ("a", True), "y": ("a", False), "z": ("c", False), "w": ("c", False), "v": (None, False)}


def test_budget_and_reports(spark):
    jobs = spark.createDataFrame([("d", i, 0.4) for i in range(5)], "doc string, pos int, cost double")
    got = [r.over for r in translate.budget(jobs, 1.0, "doc", "pos", "cost").orderBy("pos").collect()]
    assert got == [False, False, False, True, True]
    assert each(spark, X.seconds, [1234], "long") == ["1.23"] and each(spark, X.usd, [0.00005], "double") == ["0.0001"]
    assert datetime.date.today()


def test_control_characters_and_odd_marks():
    from quire.functions.markdown_html import to_html

    assert to_html("a \x02 b") == "<p>a \x02 b</p>\n" and to_html("\x027\x03 `c`  ") == "<p>\x027\x03 <code>c</code>  </p>\n"
    assert to_html("# a b ##\n\n#\n\n## c#") == "<h1>a b</h1>\n<h1></h1>\n<h2>c#</h2>\n"
    assert to_html("[a *b*](/x \"t\") ![i](y)") == '<p><a href="/x" title="t">a <em>b</em></a> <img src="y" alt="i" /></p>\n'


def test_no_text_takes_long_or_ends_the_stack():
    import time

    from quire.functions.markdown_html import to_html

    texts = ["[" * 50_000, "]" * 50_000, "[a](" * 20_000, "![" * 20_000 + "](x)" * 20_000, ">" * 5000 + " x", "- " * 3000 + "x", "`a" * 30_000, "<!--" * 20_000, "# a" + " " * 50_000 + "b", "**a " * 20_000, "~~a " * 20_000, "a\\" * 20_000, "\x02" * 50_000]
    for t in texts:
        begun = time.time()
        H.skeleton(to_html(t))
        assert time.time() - begun < 5, t[:10]
    for tag in ("div", "b", "blockquote", "ul><li"):
        html = f"<{tag}>" * 5000 + "deep" + "".join(f"</{x}>" for x in reversed(tag.split("><"))) * 5000 + "<p>after</p>"
        assert "deep" in H.to_markdown(html) and H.to_markdown(html).endswith("after")
        assert "deep" in H.sanitize(html) and H.parse(html).text() == "deepafter"


def test_a_text_that_fails_is_null(spark):
    rows = spark.createDataFrame([(1, '[{"kind": "heading", "level": 1, "children": []}]'), (2, "no json"), (3, '[{"kind": "other"}]'), (4, None)], "i int, b string")
    assert {r.i: r.m for r in rows.select("i", G.blocks_markdown("b").alias("m")).collect()} == {1: "# ", 2: None, 3: None, 4: None}
    deep = block = {"kind": "blockquote", "blocks": []}
    for _ in range(3000):
        block["blocks"].append({"kind": "blockquote", "blocks": []})
        block = block["blocks"][0]
    block["blocks"].append({"kind": "thematic-break"})
    assert G.serialize_blocks([deep]) == "> " * 3001 + "---"


def test_names_that_look_like_suffixed_ones(spark):
    from quire.operators import links as L

    stems = ["a", "a", "a-2", "a", "a-2", "b", "a-4", "b", None]
    rows = spark.createDataFrame([("d", s, ".png", k) for k, s in enumerate(stems) if s], "doc string, stem string, ext string, k int").repartition(2)
    got = {r.k: r.file_name for r in L.suffixed_names(rows, "doc", "stem", "ext", "k").collect()}
    assert got == {0: "a.png", 1: "a-3.png", 2: "a-2.png", 3: "a-5.png", 4: "a-2-2.png", 5: "b.png", 6: "a-4.png", 7: "b-2.png"}
    assert len(set(got.values())) == len(got)


def test_nested_lists_take_time_in_proportion():
    import time

    for html in ("<ol><li>" * 20_000, "<ul><li>x" * 20_000, "<ol><li>" * 20_000 + "</li></ol>" * 20_000, "<blockquote><ul><li>a" * 8000, "<ul><li>a" * 150 + "<li>b" * 20_000):
        begun = time.time()
        H.to_markdown(html)
        assert time.time() - begun < 5, html[:20]


def test_blocks_in_lists_and_quotations():
    assert H.to_markdown("<ol start=9><li>a<p>b</p><ul><li>c<li>d</ul><li><ul><li>e</ul><pre>x\n\ny </pre></ol>") == "9. a\n\n   b\n   - c\n   - d\n10. - e\n\n    ```\n    x\n\n    y\n    ```"
    assert H.to_markdown("<blockquote><p>a</p><ul><li>b<li></ul><blockquote></blockquote><h2>c</h2></blockquote><p>d") == "> a\n>\n> - b\n> -\n>\n> ## c\n\nd"
    assert H.to_markdown("<ul><li></li><li> </li></ul>") == "- \n- " and H.to_markdown("<ul></ul><blockquote> </blockquote><p>x") == "x"


def test_attribute_values_however_quoted():
    html = """<a href="1"><A HREF='2'><a href=3 ><a href=""><a href><!-- <a href="no"> --><script>"<a href='no'>"</script><a href="4&amp;5" href="6"><!-- <a href="no">"""
    assert H.attribute_values(html, "href") == ["1", "2", "3", "", "4&5"] and H.attribute_values(None, "href") == []


def test_what_a_grammar_cannot_read_is_a_failure_row(spark):
    rows = spark.createDataFrame([(1, "x", "y"), (2, "x", None), (3, None, None)], "k int, html string, markdown string")
    assert [tuple(r) for r in G.failures(rows, ["k"], "html", "markdown", "page").collect()] == [(2, "malformed-source", "Unable to read the page.")]


def test_readable_text_equals_plain_replacements(spark):
    """Texts of every mark, against the replacements made one after another."""
    import random
    import re

    ws = "[\\s\\x0b\\xa0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
    rules = ((r"(?s)```.*?```", " "), ("`[^`]*`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^[ \t]*>[ \t]?", ""), (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"(?m)^[ \t]*[0-9]+[.)][ \t]+", ""), ("[*_~#>|]", " "))
    rng = random.Random(8)
    parts = ["word", "Wort ", "x  y", "```", "`", "![a](b)", "[t](u)", "](", "> ", ">", "- ", "*", "+\t", "1. ", "2) ", "3.", "\n", "\n\n", " \t", " ", "　", "é", "~~", "#", "|", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.readable_text(X.F.col("t")).alias("readable"), X.normalize_text(X.F.col("t")).alias("normal"), X.derive_title(X.F.col("t")).alias("title")).collect()
    for r in rows:
        want = texts[r.i]
        assert r.normal == re.sub(ws + "+", " ", want).strip(" "), repr(want)
        for pattern, by in rules:
            want = re.sub(pattern, by, want)
        want = re.sub(ws + "+", " ", want).strip(" ")
        assert r.readable == want, repr(texts[r.i])
        if not re.search(r"(?m)^#{1,2}[ \t]+", texts[r.i]):
            assert r.title == (" ".join(want.split(" ")[:10]) or "Untitled"), repr(texts[r.i])


def test_grammars_work_on_slices_of_a_batch(spark):
    """A batch is parsed and handed on so many texts at a time, and equal texts of a slice once."""
    import pyarrow as pa

    seen = []
    run = G._text(lambda x: seen.append(x) or x).func
    out = list(run(iter([pa.array([str(i // 2) for i in range(600)])])))
    assert max(map(len, out)) <= G.SLICE and sum(map(len, out)) == 600 and len(seen) < 310
    batches = list(G.skeleton.func(iter([pa.array(["# a", None] * 200)])))
    assert max(map(len, batches)) <= G.SLICE and batches[0][0].as_py()["blocks"][0]["kind"] == "heading"
    model = G.unit_markdown(F.lit(None).cast("string"), F.col("b"), F.expr("map('k', 'assets/images/k.png')"))
    rows = spark.createDataFrame([(None,), ('[{"kind": "paragraph", "children": [{"kind": "image", "asset_id": "k"}]}]',), ("no json",)], "b string")
    assert [r[0] for r in rows.select(model).collect()] == [None, "![](../assets/images/k.png)", None]


def test_titles_are_looked_for_only_behind_a_leading_mark(spark):
    """Lines are only split where the first of them may be a heading; JavaScript's white space may stand before it."""
    values = ["\n\u3000# T\n\nx", "\ufeff## T\nx", "x\n# T", "#T\n# T\nx", "# A\n\n# T\n\n\ny", None, ""]
    strip = lambda c: R.strip_duplicate_title(c, F.lit("T"))
    assert each(spark, strip, values) == ["\nx", "x", "x\n# T", "#T\n# T\nx", "# A\n\ny", None, ""]
    plan = spark.createDataFrame([("x",)], "v string").select(strip(F.col("v")))._jdf.queryExecution().analyzed().toString()
    assert "]*#" in plan.split("transform(", 1)[0]
