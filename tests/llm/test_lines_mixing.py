import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import line_dedup, mixing

from .common import frame, lower, messy, words


def distance(x, y, most):
    """Edit distance, or more than ``most``: only cells that near the diagonal are filled."""
    row = {j: j for j in range(min(len(y), most) + 1)}
    for i, a in enumerate(x, 1):
        new = {}
        for j in range(max(0, i - most), min(len(y), i + most) + 1):
            cells = [row.get(j, most) + 1, new.get(j - 1, most) + 1]
            if j:
                cells.append(row.get(j - 1, most + 1) + (a != y[j - 1]))
            new[j] = min(cells)
        row = new
    return row.get(len(y), most + 1)


def near(x, y, bound=1, per_words=8):
    allowed = min(bound, min(len(x), len(y)) // per_words)
    if abs(len(x) - len(y)) > allowed or len(set(x) - set(y)) > allowed:
        return False
    return x == y if not allowed else distance(x, y, allowed) <= allowed


def place(i, t):
    """Documents in order; different texts of one doc_id are documents of their own."""
    return (i is None, i or 0, xxhash.xxh64((t or "").encode(), seed=42).intdigest() - 2**63 & 2**64 - 1)


def brute(rows, min_words=1, bound=1):
    """Cleaned text per row."""
    lines = sorted({(place(i, t), k, tuple(words(x))) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))})
    out = []
    for i, t in rows:
        if t is None:
            out.append(None)
            continue
        kept = []
        for k, x in enumerate(t.split("\n")):
            w, at = tuple(words(x)), (place(i, t), k)
            if len(w) < min_words or not any(o[:2] < at and near(w, o[2], bound) for o in lines):
                kept.append(x)
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize(("seed", "min_words", "bound"), [(0, 1, 1), (1, 3, 1), (2, 1, 2), (3, 1, 0)])
def test_kept_lines_equal_brute_force(spark, seed, min_words, bound):
    rng = random.Random(seed)
    stem = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = messy(seed, 12)
    for i in range(25):
        w = list(stem[: rng.choice([7, 8, 9, 10])])
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.pop(k), lambda: w.insert(k, rng.choice("xyz")), lambda: w.__setitem__(k, rng.choice("xyz")), lambda: w.insert(k, w[k])])()
        long = [f"w{k}" for k in range(rng.choice([15, 16, 17, 18]))]
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            k = rng.randrange(len(long))
            rng.choice([lambda: long.pop(k), lambda: long.insert(k, rng.choice("xyz")), lambda: long.__setitem__(k, rng.choice("xyz"))])()  # noqa: B023
        rows.append((1000 + i, "\n".join([" ".join(w), "Same short", rng.choice(["ALPHA beta", "a b c", "", "x"]), " ".join(w[::-1]), " ".join(long)])))
    said = ["a line that two documents hold", "b line that two documents hold"]
    rows += [(2001, said[0]), (2001, said[1]), (2002, said[0] + "\nown words"), (2003, said[1] + "\nother words"), (None, said[0]), (None, "new " + said[1]), (None, "new " + said[1] + "\nagain")]
    if bound == 2:  # a line of n words has n * n / 2 variants
        rows = [r for r in rows if len(words(r[1])) < 1000]
    docs = frame(spark, rows)
    got = line_dedup.drop_lines(docs, line_dedup.duplicate_lines(docs, min_words, bound), min_words).collect()
    key = lambda i, t: (i is None, i or 0, t is None, t or "")
    assert sorted(key(r.doc_id, r.text) for r in got) == sorted(key(i, t) for (i, _), t in zip(rows, brute(rows, min_words, bound)))
    for r in got:
        assert r.n_chars == (None if r.text is None else len(r.text)) and r.slot == 1
    for r in got:
        assert r.emptied == (r.n_dropped > 0 and not words(r.text)) and (r.n_lines > 0) == (r.text is not None)


def test_names_of_other_columns(spark):
    text = "one line of words\nanother line"
    docs = spark.createDataFrame([(i, text, "a", "b", "c", i, "d") for i in range(3)], "doc_id long, text string, row string, gone string, t string, d int, of string")
    got = line_dedup.drop_lines(docs, line_dedup.duplicate_lines(docs))
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "emptied"]
    assert sorted(tuple(r)[:7] for r in got.collect()) == [(i, text if not i else "", "a", "b", "c", i, "d") for i in range(3)]
    with pytest.raises(ValueError, match="bound"):
        line_dedup.duplicate_lines(docs, bound=3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 2))
def test_distances(x, y, bound):
    assert line_dedup.within(np.array(x), np.array(y), bound) == (distance(x, y, bound) <= bound)


def test_no_rows_and_line_splitting(spark):
    empty = frame(spark, [(1, "x")]).where("false")
    assert line_dedup.drop_lines(empty, line_dedup.duplicate_lines(empty)).count() == 0
    texts = [None, "", "a", "\n", "a\n", "\n\nb c\n d", "x y\nz", None, "é\nü"]
    got = line_dedup.Lines(pa.array(texts, pa.large_string()))
    want = [(d, k, len(words(x))) for d, t in enumerate(texts) if t is not None for k, x in enumerate(t.split("\n"))]
    assert list(zip(got.doc.tolist(), got.no.tolist(), got.n.tolist())) == want


def mixed(spark, rows, **options):
    docs = spark.createDataFrame([(*r, f"h{k}") for k, r in enumerate(rows)], "doc_id long, source string, size long, text_md5 string")
    return docs, mixing.mix(docs, **options).collect()


def test_deviation_is_less_than_one_block(spark):
    rows = [(i, f"s{0 if i % 3 else i % 7}", 50) for i in range(4000)]
    _, got = mixed(spark, rows, block_chars=500, resolution=40)
    assert len(got) == len(rows) and len({r.doc_id for r in got}) == len(rows)
    slots = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        slots.setdefault(r.slot, set()).add((r.source_key, r.block))
    assert all(len(v) == 1 for v in slots.values())  # one block a slot
    plan = mixing.plan(spark.createDataFrame([(s, sum(1 for r in rows if r[1] == s) * 50) for s in {r[1] for r in rows}], "source_key string, size long"), resolution=40).collect()
    period = plan[0].period
    assert sorted(x for p in plan for x in p.slots) == list(range(period))
    for p in plan:
        for t in range(1, period + 1):
            assert abs(sum(s < t for s in p.slots) - t * p.c / period) < 1


def test_weights_order_and_odd_rows(spark):
    rows = [(i, "big" if i % 3 else "small", 100) for i in range(900)] + [(None, None, None), (5, "big", 100), (5, "big", 100), (7, "long", 10**6), (8, "long", 1)]
    weights = {"big": 0.5, "small": 0.5, "unknown": 1.0, "long": 0.25, "\\N": 0.001, "gone": 0}
    rows += [(1000, "gone", 100), (1001, "unlisted", 100)]
    docs, got = mixed(spark, rows, weights=weights, block_chars=1000, resolution=10)
    assert len(got) == docs.count() - 2 and not {"gone", "unlisted"} & {r.source_key for r in got}
    assert mixing.mix(docs, weights={"big": 0.0}).count() == mixing.mix(docs, weights={}).count() == 0
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="weights"):
            mixing.mix(docs, weights={"big": bad})
    end = min(max(r.slot for r in got if r.source_key == k) for k in ("big", "small"))
    early = {k: len({r.block for r in got if r.source_key == k and r.slot <= end}) for k in ("big", "small")}
    assert abs(early["big"] - early["small"]) <= 2
    for k in ("big", "small", "long"):
        own = sorted((r.slot, r.place) for r in got if r.source_key == k)
        assert own == sorted(own, key=lambda x: x[1])  # places and slots rise together
    assert [r.source_key for r in got if r.doc_id is None] == ["\\N"]
    assert mixing.mix(docs.where("false")).count() == 0


@pytest.mark.parametrize(
    "weights",
    [
        {f"t{i}": 0.0001 for i in range(300)} | {"big": 0.97, "none": 0.0},
        {"a": 1 / 3, "b": 2 / 3},
        {"a": 7, "b": 2, "c": 1},
        {"a": 0.5, "b": 0.3333, "c": 0.1667},
    ],
)
def test_shares_are_the_targets(spark, weights):
    stats = spark.createDataFrame([(k, 10 * n) for n, k in enumerate(weights)], "source_key string, size long")
    got = mixing.plan(stats, weights).collect()
    assert {p.source_key for p in got} == {k for k, w in weights.items() if w > 0}
    period, total = got[0].period, sum(weights.values())
    assert sorted(x for p in got for x in p.slots) == list(range(period))
    for p in got:
        share = weights[p.source_key] / total
        # over three periods, so an error that adds up would show
        slots = [s + turn * period for turn in range(3) for s in p.slots]
        assert max(max(abs(k - s * share), abs(k + 1 - (s + 1) * share)) for k, s in enumerate(slots)) < 1


def test_columns_keep_their_names(spark):
    rows = [(i, "word " * i, f"s{i % 2}", i, "mine") for i in range(1, 60)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, source string, size long, before string, chunk string, row string")
    got = mixing.mix(docs, block_chars=200)
    assert got.columns == [*docs.columns, *mixing._ADDED]
    assert sorted(tuple(r)[:7] for r in got.collect()) == sorted(map(tuple, docs.collect()))


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, f"text {i}", "s") for i in range(3000)] + [(7, f"other {i}", "s") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_chars=500).collect()
    places, sizes = sorted((r.place, len(r.text)) for r in got), 0
    for place, n in places:  # one after another, whatever the chunks
        assert place == sizes
        sizes += n


def test_many_sources_use_salts(spark, monkeypatch):
    rows = [(i, f"s{i % 4}", 10) for i in range(200)]
    _, want = mixed(spark, rows, block_chars=100, resolution=8)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    _, got = mixed(spark, rows, block_chars=100, resolution=8)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_mixing_equals_its_sql(spark):
    rows = [(i, None if k % 5 == 0 else f"s{k % 3}", t) for k, (i, t) in enumerate(messy(7, 30)) if i is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_chars=300, resolution=20)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "source": pa.array([r[1] for r in rows], pa.string()), "text": pa.array([r[2] for r in rows], pa.string())}))
    want = con.sql(mixing.oracle_sql(block_chars=300, resolution=20)).fetchall()
    assert sorted(tuple(r) for r in got.select("doc_id", "source_key", "block", "release", "deadline", "slot", "place").collect()) == sorted(want)
    assert lower("ÀB") == "Àb"


def without_copied_runs(rows):
    """What ``short_runs`` drops, plainly, for rows with different doc_ids: cleaned text per row."""
    texts = {i: t.split("\n") for i, t in rows}
    size = {(i, k): len(words(x)) for i, t in texts.items() for k, x in enumerate(t)}
    same = lambda a, b: words(texts[a[0]][a[1]]) == words(texts[b[0]][b[1]])
    edited = lambda a, b: near(words(texts[a[0]][a[1]]), words(texts[b[0]][b[1]]))
    first = {a: min(b for b in size if same(a, b)) for a in size}
    gone = {a for a in size if size[a] >= 3 and (first[a] < a or any(b < first[a] and edited(a, b) for b in size))}

    def beside(a, step):
        k = a[1] + step
        while (a[0], k) in size and size[a[0], k] < 3:
            k += step
        return (a[0], k) if (a[0], k) in size else None

    def repeats(a, step):
        n = beside(a, step)
        return n and any(b < a and same(a, b) and (m := beside(b, step)) and m[1] - b[1] == n[1] - a[1] and same(n, m) for b in size if 0 < size[b] < 3)

    short = {a for a in size if 0 < size[a] < 3 and all(n is None or n in gone for n in (beside(a, -1), beside(a, 1))) and (repeats(a, -1) or repeats(a, 1))}
    return ["\n".join(x for k, x in enumerate(texts[i]) if (i, k) not in gone | short) for i, _ in rows]


def test_short_lines_of_copied_runs_go(spark):
    rng = random.Random(5)
    pool = ["Title", "The end", "*", "", "one two three", "four five six seven", "a b c d e f g h i", "a b c d e f g h j", "k l m n o p q r s t", "k l m n o p q r s"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(100, "Head\nunique line of words\nMiddle\nanother unique line here\nTail"), (101, "Head\nunique line of words\nMiddle\nanother unique line here\nTail")]
    rows += [(102, "Head\nunique line of words\nNew one\nanother unique line here\nTail\nsomething not seen before")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in line_dedup.drop_lines(docs, line_dedup.duplicate_lines(docs, min_words=3, short_runs=True), min_words=3, short_runs=True).collect()}
    want = dict(zip([i for i, _ in rows], without_copied_runs(rows)))
    assert {i: r.text for i, r in got.items()} == want
    assert got[100].text == rows[60][1] and got[101].emptied and got[102].text == "New one\nTail\nsomething not seen before"
    assert sum(w != t for w, t in zip(want.values(), brute(rows, 3))) > 5


def test_exact_copies_leave_no_stub_in_the_pipeline(spark):
    import corpus_pipeline

    text = "Title\n\na line of some words\nTwo words\na second line of words\nEnd"
    docs = spark.createDataFrame([(i, text if i < 4 else "Title\nquite other words here", "en", "s", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()) == [(0, text), (4, "Title\nquite other words here")]
