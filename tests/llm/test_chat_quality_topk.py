import hashlib
import re
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bitsliced, chat, quality

from .common import frame, messy

T = chat.Template()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("\\#</turn>: \nab"), max_size=30), st.text(st.sampled_from("\\#</turn>: \nab"), max_size=8))
def test_turns_survive_formatting(text, role):
    turn = T.head + T.escaped(role, True) + T.role_end + T.escaped(text) + T.tail
    assert T.parsed(turn) == (role, text) and T.unescaped(T.escaped(text)) == text
    # no text can end its turn or open another one
    assert not re.search(r"(?<!\\)###|(?<!\\)</turn>", T.escaped(text).replace("\\\\", "x"))  # an escaped escape is a character of its own


def test_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a </turn>"), (1, 3, "user", None), (1, 4, "assistant", "b"), (2, 0, "assistant", "x"), (3, 0, "user", "a"), (3, 1, "user", "b"), (4, 0, "user", ""), (4, 0, "user", ""), (None, 0, "user", "n"), (5, None, None, None), (5, 1, "user", "é😀"), (6, 0, "user", "z" * 100_000)]
    rows += [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, valid string").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.segments(df)).collect()}
    groups = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
        assert got[c].formatted_chars == sum(len(T.head + T.escaped(a, True) + T.role_end + T.escaped(b) + T.tail) for a, b in turns)
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: False, 6: True, 7: True}
    segs = chat.segments(df).where("conv_id = 1").collect()
    assert [s.loss for s in segs if s.part == 1] == [False, False, True, False, True] and not any(s.loss for s in segs if s.part != 1)
    assert chat.digests(chat.segments(df.where("false"))).count() == 0


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    n, c = len(w), {}
    for k in range(n - 2):
        c[tuple(w[k : k + 3])] = c.get(tuple(w[k : k + 3]), 0) + 1
    cover = {k + d for k in range(n - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n)


def test_base_counts(spark):
    rows = messy(8, 20) + [(900, "a a a a a"), (901, "x y z\nx y z\n x y z\n\n\nx y z"), (902, "# a *b* $%&|<> é\nA b"), (903, "a b c " * 60)]
    got = quality.clean(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r.slot for r in got} == {1}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(base(t))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in texts[r.doc_id]
        assert not (r.kept and r.base_failed)
    assert quality.clean(frame(spark, rows).where("false")).count() == 0


def words(n, mark=""):
    return " ".join(f"Word{i}{mark}" for i in range(n))


@pytest.mark.parametrize(
    ("text", "kept", "failed"),
    [
        (words(60) + ".", True, 0),
        (words(60) + "…", True, 0),
        (words(30) + ".\n" + words(30).lower() + " x. and then cut of", True, 0),
        (words(60), False, 1),
        (words(60, "%%%") + ".", False, 1),
        (words(60).upper() + "!!", False, 1),
        (words(60) + ".\nHome | News. | Contact", True, 1),
        (words(60).replace(" ", " | ") + ".", False, 1),
        (words(60) + ".\nAll rights reserved.", True, 1),
        (words(40) + ".\n" + words(30, "&&") + ".", False, 1),
        (words(20) + ".", False, 0),
        (words(70) + ".\n" + words(30, "x"), True, 1),  # exactly three words in ten are lost
        (words(69) + ".\n" + words(31, "x"), False, 1),
        (words(60) + ".\nAlle Rechte vorbehalten.\nPolítica de privacidad.\nTous droits réservés.", True, 3),
        (None, False, 0),
    ],
)
def test_line_rules(text, kept, failed):
    import pyarrow as pa

    got, _ = quality.measure(pa.array([text], pa.large_string()))
    assert (bool(got["kept"][0]), int(got["n_failed_lines"][0])) == (kept, failed)


def failed(line):
    """The line rules, plainly."""
    w = re.findall(r"[^\x20\x09-\x0D]+", line)
    ended = any(x[-1] in ".!?:;\"')]…”’»。！？" for x in w)
    caps, letters = len(re.findall("[A-Z]", line)), len(re.findall("[A-Za-z]", line))
    dividers = sum(x in ("|", ">", "»", "•", "·", "-") for x in w)
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return bool(w) and (not ended or 10 * len(re.findall(r"[#*$%&|<>]", line)) > len(w) or (len(w) >= 5 and 5 * caps > 3 * letters) or (dividers >= 2 and 10 * dividers >= len(w)) or any(b.decode() in low for b in quality.BOILERPLATE))


LINES = st.lists(st.sampled_from(["", " ", "Good line.", "no end", "SHOUT ONE TWO THREE FOUR!", "click here.", "A | b | c.", "é: ü", "\t"]), max_size=6).map("\n".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), LINES), max_size=8))
def test_failed_lines_go(texts):
    import pyarrow as pa

    counts, got = quality.measure(pa.array(texts, pa.large_string()))
    assert got.to_pylist() == [None if t is None else "\n".join(x for x in t.split("\n") if not failed(x)) for t in texts]
    assert counts["n_failed_lines"].tolist() == [sum(map(failed, (t or "").split("\n"))) for t in texts]


def test_cleaned_documents(spark):
    long = "\n".join([words(40) + "."] * 3000 + ["Home | News. | Contact"])
    rows = [(1, words(60) + ".\nno end\n\nclick here."), (1, words(60) + ".\nno end\n\nclick here."), (2, None), (3, "no end"), (4, long), (None, words(60) + ".")]
    got = quality.clean(frame(spark, rows))
    assert set(frame(spark, rows).columns) <= set(got.columns)
    text = {(r.doc_id, r.text): (r.kept, r.n_failed_lines) for r in got.collect()}
    assert text == {(1, words(60) + ".\n"): (True, 2), (2, None): (False, 0), (3, ""): (False, 1), (4, long[: long.rindex("\n")]): (False, 1), (None, words(60) + "."): (True, 0)}


def plain_top(values, k, query, without):
    scores = values @ query
    rows = [i for i in np.lexsort((np.arange(len(values)), -scores)) if i != without][:k]
    return rows, [scores[i] for i in rows]


@pytest.mark.parametrize("shape", [(1, 3), (63, 1), (64, 5), (65, 8), (500, 12)])
def test_bit_slices_equal_products(shape):
    rng = np.random.default_rng(shape[0])
    for low, high in ((-256, 256), (-3, 3), (0, 2), (-1, 0)):
        values = rng.integers(low, high, shape)
        index = bitsliced.Index(values)
        for query in [*rng.integers(low - 1, high + 1, (5, shape[1])), np.zeros(shape[1], dtype=int)]:
            for without in (None, 0):
                rows, scores = index.top(query, 5, without)
                want = plain_top(values, 5, query, without)
                assert sorted(zip(rows.tolist(), scores.tolist())) == sorted(zip(map(int, want[0]), map(int, want[1])))


def test_searches(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 40)
    monkeypatch.setattr(bitsliced, "GROUP_QUERIES", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(300)]
    for i in range(120, 160):
        rows[i] = (i, rows[7][1])  # ties
    rows[9], rows[11], rows[50], rows[13] = (9, None), (11, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (50, [float("nan")] * 6), (13, [float("inf")] * 6)
    rows += [(400, [0.1, 0.2]), (401, [0.3, 0.4]), (450, [1.0] * 7), (None, [1.0] * 6), (20, rows[20][1]), (0, rows[0][1]), (402, [])]
    rows += [(30, [9.0] * 6), (30, [9.0] * 6), (100, [-0.0, 0.0, 0.5, 0.25, 0.0, 1.0]), (150, [5e-324, -5e-324, 1.0, 1.0, 1.0, 1.0]), (150, [0.5] * 6)]
    check_searches(spark, rows)


def check_searches(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(3)
    got = bitsliced.top_k(df, df.where("vec_id % 50 = 0"), k=5).collect()
    good = [(i, [floor(Fraction(x) * 256) for x in v]) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    near = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = []
    for own, (q, w) in enumerate(good):
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for k, (i, v) in enumerate(good) if k != own and len(v) == len(w))[:5]
            want += [(q, n + 1, i, near(-s)) for n, (s, i) in enumerate(found)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert bitsliced.top_k(df.where("false"), df.where("false")).count() == 0


def test_rows_that_share_an_id_are_candidates(spark):
    check_searches(spark, [(0, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [0.0, 1.0])])


def test_any_finite_component(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_CELLS", 600)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=3) * 10.0 ** rng.integers(-3, 3)]) for i in range(60)]
    rows += [(70, [1e10, 1.0, -1.0]), (71, [-1e30, 2.0, 1e30]), (72, [1e300, -1e300, 1e-310]), (73, [1.7976931348623157e308, 1.0, 1.0]), (100, [1e30, -1e30, 3.0]), (150, [1.5e308, 0.1, -1e308]), (200, [0.1, -5e-324, 2.0**40])]
    rows += [(80 + k, [1e25 * k, 0.0, 1.0]) for k in range(6)]  # scores beyond a long, ranked by their true value
    check_searches(spark, rows)
