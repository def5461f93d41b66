import itertools
import random

import numpy as np
import pyarrow as pa

from quire.llm import crf, toxicity

from .common import frame, messy, sentence


def corpus(n, seed=0):
    rng = random.Random(seed)
    bad = ["gromf", "vilokra", "vilostan"]
    rows = []
    for i in range(n):
        w = sentence(rng, rng.randint(30, 90)).split()
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad[:1] + ["vilo" + rng.choice(["kra", "stan", "mer", "tig", "pos"])]) + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_messages_equal_enumeration():
    rng = np.random.default_rng(0)
    unary, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    p = np.zeros(7)
    total = 0.0
    for states in itertools.product((0, 1), repeat=7):
        s = sum(unary[i] for i in range(7) if states[i]) + sum(trans[a, b] for a, b in zip((0, *states[:-1]), states))
        total += np.exp(s)
        p += np.exp(s) * np.array(states)
    _, _, log_z = crf.messages(unary, np.array([0, 7]), trans)
    assert np.allclose(crf.marginals(unary, np.array([0, 7]), trans), p / total) and np.isclose(log_z, np.log(total))


def test_segments_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    starts = np.array([0, 0, 5, 5, 300, 301, 700])
    unary, trans = rng.normal(size=700) * 3, rng.normal(size=(2, 2))
    want = crf.marginals(unary, starts, trans)
    monkeypatch.setattr(crf, "SEGMENT", 7)
    assert np.allclose(crf.marginals(unary, starts, trans), want)


def test_held_out_accuracy_scores_and_spans(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.tag(docs, model).withColumn("held_out", toxicity.held_out()).collect()}
    held = [(out[i], y, t) for i, t, y in rows if out[i].held_out]
    assert len(held) > 100 and all((r.score >= 0.3) == bool(y) for r, y, _ in held)
    for r, y, text in held:
        found = [text[s.begin : s.end].lower() for s in r.spans]
        assert bool(found) == bool(y) and all("gromf" in f or "vilo" in f for f in found)


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.head, b.head)


def test_messy_rows_and_no_labels(spark):
    docs = frame(spark, messy(2, 10))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(0, 1), (3, 1), (None, 0), (6, None)], "doc_id long, toxic int")
    for labels, want in ((none, 0.0), (one, 1.0)):
        got = toxicity.tag(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == docs.count() and {r.score for r in got} == {want} and all(r.spans == [] for r in got)
    rows = corpus(200)
    model = toxicity.train(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = toxicity.tag(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in got) and toxicity.tag(docs.where("false"), model).count() == 0
    assert set(docs.columns) - {"score"} <= set(toxicity.tag(docs, model).columns)


def test_offsets_count_code_points():
    model = toxicity.fit([t for _, t, _ in corpus(200)], np.array([y for *_, y in corpus(200)]), 0.25)
    text = "日本 éé gromf 😀 Gromf!"
    words = toxicity.tokens(pa.array([text, None, ""], pa.large_string()))
    spans = toxicity._spans(words, model.token_marginals(words)).to_pylist()
    assert [text[s["begin"] : s["end"]] for s in spans[0]] and all(text[s["begin"] : s["end"]].lower().startswith("gromf") for s in spans[0]) and spans[1:] == [[], []]


def test_long_texts_train_whole_within_the_bound(spark, monkeypatch):
    rows = [(i, t if y else t + " stone" * (2000 if i % 3 == 0 else 1), y) for i, t, y in corpus(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, share: seen.append(list(zip(texts, toxic))))
    toxicity.train(docs, labels)
    whole = {t for _, t, _ in rows}
    assert {t for t, _ in seen[0]} <= whole and max(len(t) for t, _ in seen[0]) > 10_000
    toxicity.train(docs, labels, 10, 1300)
    for c in (0, 1):
        own = [len(t) for t, y in seen[1] if y == c]
        assert 0 < len(own) <= 10 and sum(own) <= 13_000
