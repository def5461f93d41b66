import hashlib
import random
import re
import time

import numpy as np
import pytest

from quire.llm import boosting, pii, queries

from .common import frame, messy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

HARD = [
    "a@b.c@d.e x@y a@b..c @a.b .%@h.i.j. a@b.c_x@d.e a@@b.c é@x.yz",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 .1.2.3.4. 999.1.2.3.4.5 1.2.3.4,5.6.7.8",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 11111111 378282246310005 5-5 0000000000000000 4111111111111112 24111111111111111x",
    "+1 (377) 555-0271 +49 30 1234567 +12 +1 +1-2 ++33 1 23 45 67 89 +1.2.3.4.5.6.7.8.9.0 +123456789012345678 (+44) 20 7946 0958.",
    "日本 +1 (377) 555-0271 😀 me@x.org",
    "mail a.b@c.de\ntel +1 222 333 4444\n4111 1111 1111\n1111",
]


def brute(text):
    """The base rule with the patterns as they are."""
    out = []
    for k, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in twice) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, begin, end) for begin, _, kind, end in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("@@..--++ 0123459ab()\n") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [pii.planted("some words that stand around here " * 4, s)[0] for s in range(60)]
    for t in texts:
        assert pii.base_spans(t) == brute(t), t


@pytest.mark.parametrize("text", ["7" * 400_000, "a" * 400_000, "a" * 400_000 + "@", "1 " * 200_000, "1." * 200_000, "@" * 100_000, "+1" * 100_000, "AB12" * 60_000, "ab:" * 100_000, "x at y dot " * 20_000])
def test_long_runs_take_time_in_proportion(text):
    begun = time.time()
    pii.base_spans(text)
    spans = pii.candidates(text)
    pii.features(text, spans[:1000])
    assert time.time() - begun < 12


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000], rounds=40)
    assert (((model.probability(x[2000:]) > 0.5) == y[2000:]).mean()) > 0.95
    assert boosting.fit(x[:0], y[:0]).probability(x[:3]).shape == (3,)
    assert np.allclose(boosting.fit(x[:9], np.ones(9)).probability(x[:2]), 0.999, atol=1e-3)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return pii.fit([" ".join(rng.choice(["stone", "river", "walked", "über", "la", "night."]) for _ in range(120)) for _ in range(300)])


def test_held_out_precision_and_recall(model):
    """Planted documents that the trees have not seen: other words around, other values."""
    x, y, kinds, _ = pii._examples([(90_000 + i, "the old house was sold and nobody knew why it stood there " * 6) for i in range(300)])
    p = model.trees.probability(x)
    for k, kind in enumerate(pii.KINDS):
        mine = kinds == k
        chosen = p[mine] >= model.threshold[kind]
        assert y[mine][chosen].mean() > 0.95, kind
        assert chosen[y[mine]].mean() > 0.85, kind


def found(text, model):
    spans = pii.candidates(text)
    return [(s[0], text[s[1] : s[2]]) for s in pii.select(text, spans, pii._judged([text], [spans], model), model.threshold, pii.base_spans(text))]


def test_what_the_patterns_miss_is_added(model):
    for text, want in (
        ("Write to john.doe (at) example (dot) com today", ("email", "john.doe (at) example (dot) com")),
        ("call (555) 123-4567 now", ("phone", "(555) 123-4567")),
        ("the host 2001:db8::ff00:42:8329 is up", ("ip", "2001:db8::ff00:42:8329")),
        ("IBAN: DE89 3704 0044 0532 0130 00", ("iban", "DE89 3704 0044 0532 0130 00")),
        ("card 4111.1111.1111.1111 was charged", ("card", "4111.1111.1111.1111")),
    ):
        assert want in found(text, model), text


def test_clean_texts_are_left_alone(model):
    for text in ("It was 2024-01-02 12:30:45 when version 1.2.3 came out.", "order 4821993 of 12,345,678.90 is ISBN 978-3-16-148410-0", "We met at home. He left at noon.", "It was late. At midnight. AT dawn.they left", "years 1999 2000 2001 2002", "token = \"269b1cea0846965f2d3ecb5cdb87c0edc7a7a587\"", "9807915762804490 is no card"):
        assert found(text, model) == [], text


def test_added_spans_overlap_nothing():
    base = [("email", 0, 5)]
    spans = [("phone", 3, 9), ("phone", 10, 20), ("card", 12, 20), ("ssn", 30, 35)]
    out = pii.select("x" * 40, spans, np.array([0.9, 0.8, 0.95, 0.4]), dict.fromkeys(pii.KINDS, 0.5), base)
    assert [(s[0], s[1], s[4]) for s in out] == [("email", 0, True), ("card", 12, False)]


def test_query_on_messy_rows(spark, tmp_path):
    rows = messy(3, 10) + [(1000 + i, t) for i, t in enumerate(HARD)] + [(2000, "x " * 50_000 + "me@x.org"), (1000, HARD[0])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op11_pii"](spark, str(tmp_path)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == sorted((-1 if i is None else i) for i, _ in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    for r in got:
        options = []
        for t in texts[r.doc_id]:
            base = brute(t or "")
            listed = ",".join(":".join(map(str, s)) for s in base)
            options.append((*(sum(s[0] == k for s in base) for k in pii.BASE_KINDS), hashlib.sha256(listed.encode()).hexdigest()))
            if options[-1] == (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256):
                spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
                assert set(filter(None, listed.split(","))) <= set(r.spans.split(",")) and len(spans) == r.n_spans
                assert [(int(b), pii.KINDS.index(k)) for k, b, _ in spans] == sorted((int(b), pii.KINDS.index(k)) for k, b, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) in options, r


def test_redaction_and_empty_table(spark, model):
    docs = frame(spark, [(1, "to a@b.cd or +1 (377) 555-0271."), (2, None), (3, "")]).withColumnRenamed("slot", "spans")
    rows = {r.doc_id: r for r in pii.redact(pii.find(docs, model)).collect()}
    assert rows[1].text == "to <EMAIL> or <PHONE>." and rows[2].text is None and rows[2].spans == [] and rows[3].text == ""
    assert rows[1].source is None or rows[1].size == "x"
    empty = docs.where("doc_id > 99")
    assert pii.digests(pii.find(empty, pii.train(empty))).count() == 0


def test_every_whole_document_is_an_example(spark):
    """More documents than a sample would take, long ones with a candidate at the very end only, one without an id."""
    rows = [(i if i else None, "word " * 700 + f"555-01{i:02d} is {i}") for i in range(40)] + [(100 + i, f"see 192.168.{i % 250}.7 there") for i in range(900)] + [(7, None)]
    docs = frame(spark, rows)
    got = pii.examples(docs).groupBy("kind", "label").count().collect()
    filler = pii.examples(docs.where("doc_id < 0")).groupBy("kind", "label").count().collect()
    count = lambda rows, kind, label: sum(r["count"] for r in rows if (r.kind, r.label) == (pii.KINDS.index(kind), label))
    assert count(got, "ip", True) - count(filler, "ip", True) >= 900  # base spans of all documents; planting only adds
    assert count(got, "phone", False) - count(filler, "phone", False) >= 36  # a look-alike may land next to a few
    model = pii.train(docs)
    assert model.trees.probability(pii.features("at 10.0.0.7 now", [("ip", 3, 11)]))[0] > 0.5 and set(model.threshold) == set(pii.KINDS)
