"""Scans over ordered rows against plain loops, with one document that holds most rows and lies in many parts."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import links, render, translate
from quire.operators import units as U
from quire.operators.scan import scan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    docs = ["hot"] * 300 + ["b", "b", "c", None, None, "", "d"]
    out = [(d, None if rng.random() < 0.05 else i, rng.choice([None, "u%d" % i]), rng.randrange(9), "text %d" % i) for i, d in enumerate(docs)]
    rng.shuffle(out)
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for d, mine in by.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1]))
        values = [r[2] for r in mine]
        known = [v for v in values if v is not None]
        for k, r in enumerate(mine):
            if r[1] is None:
                continue  # ties: any order is right
            out[r[4]] = (sum(x[3] for x in mine[:k]), next((v for v in reversed(values[: k + 1]) if v is not None), None), known[0] if known else None, values[k - 1] if k else None, values[k + 1] if k + 1 < len(mine) else None)
    return out


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("wide", [(), ("text",)])
def test_scan_equals_plain_loops(spark, rows, parts, wide):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc string, at int, v string, n int, text string").repartition(5)
        v = F.col("v")
        found = scan(df, "doc", "at", wide=wide, before={"sum": F.col("n")}, last={"last": v}, first={"first": v}, lag={"prev": v}, lead={"next": v})
        assert found.columns == ["doc", "at", "v", "n", "text", "sum", "last", "first", "prev", "next"]
        got = {r.text: (r.sum, r.last, r["first"], r.prev, r.next) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    want = brute(rows)
    # rows beside those without an order value may see any of them
    loose = {k for k, w in want.items() if any(x[1] is None for x in rows if (x[0]) == next(r[0] for r in rows if r[4] == k))}
    assert {k: got[k] for k in want if k not in loose} == {k: w for k, w in want.items() if k not in loose}
    assert {k: got[k][0] for k in want} == {k: w[0] for k, w in want.items()}


def test_one_document_is_spread_over_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit("one").alias("doc"), F.col("id").alias("at"))
        found = U.numbered(df, "doc", "at", neighbours=True)
        assert "Window [" in plan(found) and "[doc#" not in plan(found).split("Window [")[1].split("], [")[1]
        last = found.orderBy(F.desc("at")).first()
        assert (last.pos, last.unit_id, last.prev_id, last.next_id) == (20_000, "unit-20000", "unit-19999", None)
        assert found.where(F.col("pos") != F.col("at") + 1).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_take_part_in_no_sort(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("doc"), F.col("id").alias("at"), F.repeat(F.lit("x"), 100).alias("markdown"))
    found = U.numbered(df, "doc", "at", wide=("markdown",))
    assert "ShuffledHashJoin" in plan(found) or "BroadcastHashJoin" in plan(found)
    assert found.columns == ["doc", "at", "markdown", "pos", "unit_id"] and found.where("length(markdown) = 100").count() == 50


def test_empty_rows(spark):
    df = spark.createDataFrame([], "doc string, at int, markdown string")
    assert U.numbered(df, "doc", "at", wide=("markdown",), neighbours=True).count() == 0
    assert U.sections(df, "doc", "at", "markdown").count() == 0


def test_sections_go_on_over_pages(spark):
    pages = [
        ("a", 1, "loose words\n\nCHAPTER 1\r\nfirst line"), ("a", 2, "still first\n-- 2 of 9 --"), ("a", 3, "\n \n"), ("a", 4, "end of first\n1. Next Part\nbody *x*"),
        ("b", 1, "no heading here\nat all"), ("c", 1, ""), ("c", 2, None), ("d", 1, "Chapter one\nChapter two"), (None, 1, "INTRO\nx"),
    ]
    got = {(r[0], r.pos): (r.title, r.page, r.line_no, r.confidence, r.n_lines, r.markdown) for r in U.sections(spark.createDataFrame(pages, "doc string, page int, text string").repartition(4), "doc", "page").collect()}
    assert got == {
        ("a", 1): ("Document", 1, 0, 0.8, 1, "loose words"),
        ("a", 2): ("CHAPTER 1", 1, 2, 0.8, 4, "# CHAPTER 1\n\nfirst line\n\nstill first\n\nend of first"),
        ("a", 3): ("1. Next Part", 4, 1, 0.8, 2, "# 1. Next Part\n\nbody \\*x\\*"),
        ("b", 1): ("Document", 1, 0, 0.5, 2, "no heading here\n\nat all"),
        ("d", 1): ("Chapter one", 1, 0, 0.8, 1, "# Chapter one"),
        ("d", 2): ("Chapter two", 1, 1, 0.8, 1, "# Chapter two"),
        (None, 1): ("INTRO", 1, 0, 0.8, 2, "# INTRO\n\nx"),
    }


def test_title_pages_join_the_next_body(spark):
    rows = [("a", 1, "t1", "p1", False), ("a", 2, "t2", "p2", False), ("a", 3, "b3", "p3", True), ("a", 4, "b4", "p4", True), ("a", 5, "t5", "p5", False), ("b", 1, "t", "q", False)]
    df = spark.createDataFrame(rows, "doc string, k int, markdown string, path string, body boolean")
    got = [(r.doc, r.k, r.markdown, r.path, r.paths) for r in U.merge_title_pages(df, "doc", "k", F.col("body")).orderBy("k").collect()]
    assert got == [("a", 3, "t1\n\nt2\n\nb3", "p3", ["p1", "p2", "p3"]), ("a", 4, "b4", "p4", ["p4"])]
    assert {(r.doc, r.k) for r in U.dropped_units(df, "doc", "k", F.col("body")).collect()} == {("a", 5), ("b", 1)}


def test_backward_attachment_over_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        units = spark.createDataFrame([("hot", 100 * k, "u%03d" % k) for k in range(1, 30)] + [("b", 5, "v")], "doc string, at int, unit string")
        events = spark.createDataFrame([("hot", k, k) for k in range(3000)] + [("b", 4, -1), ("none", 4, -2)], "doc string, at int, id int")
        got = {r.id: (r.attached, r.low_confidence) for r in U.attach_backward(events, units, "doc", "at", "at", "unit").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: (("u%03d" % max(k // 100, 1)), k < 100) for k in range(3000)} | {-1: ("v", True), -2: (None, False)}


def test_budget_is_exact(spark):
    jobs = spark.createDataFrame([("d", k, 0.1) for k in range(30)], "doc string, pos int, cost double")
    got = [(r.spent, r.over) for r in translate.budget(jobs, 1.0, "doc", "pos", "cost").orderBy("pos").collect()]
    assert got == [(k / 10, k >= 10) for k in range(30)]


def test_contents_pages_are_put_together_from_pieces(spark, monkeypatch):
    units = spark.range(1, 26).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("pos"), F.format_string("unit-%03d", "id").alias("unit_id"), F.lit("T").alias("title"))
    whole = render.index_content(units, "doc", F.lit("D")).first()
    monkeypatch.setattr(render, "PIECE", 4)
    assert render.index_pieces(units, "doc").count() == 7
    assert render.index_content(units, "doc", F.lit("D")).first() == whole and whole.n_units == 25 and whole.content.count("<li>") == 25


def test_first_seen_numbers(spark):
    refs = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "x", 0), ("b", "y", 7)], "doc string, res string, at int")
    assert {(r.doc, r.res): r.asset_id for r in links.first_seen_ids(refs, "doc", "res", "at").collect()} == {("a", "x"): "asset-001", ("a", "y"): "asset-002", ("b", "y"): "asset-001"}
