import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import collocations as C
from quire.llm import queries

from .common import frame, lower, messy


def brute(rows, support=100, longest=5, covered=100, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text) rows, by plain counting."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    kept = {p: a for p, a in counts.items() if a >= support and len(p[1]) > 1}
    inside = Counter()
    for (lang, w), a in kept.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inside[lang, w[i : i + size]] = max(inside[lang, w[i : i + size]], a)
    out = []
    for (lang, w), a in kept.items():
        if inside[lang, w] and 100 * inside[lang, w] >= covered * a:
            continue
        score, cut = min((1000 * a * n[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:cut]], counts[lang, w[cut:]]))
    found, rank = [], Counter()
    for lang, score, a, phrase, le, ri in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), -a, le, ri, n[lang], -score))
    return found


def texts(seed, n):
    rng = random.Random(seed)
    fixed = ["New York city hall", "as soon as possible", "à la carte", "of the of the of the", "日本 語 x", "e.g. this, or that"]
    small = ["of", "the", "The", "stone", "river", "blue", "a", "é", "😀", "x\tyz", "end.", "stop,", "go\nnow", "w:"]
    return [(rng.choice(["en", "de", None, "", "en"]), "  ".join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(small) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def run(df, **kw):
    return [tuple(r) for r in C.collocations(df, **kw).orderBy("lang", "rank").collect()]


@pytest.mark.parametrize("kw", [{"support": 5}, {"support": 5, "covered": 60, "top": 7}, {"support": 1, "longest": 3}, {"support": 300, "longest": 4}])
def test_equals_brute_force(spark, kw):
    rows = texts(1, 300)
    assert run(spark.createDataFrame(rows, "lang string, text string").repartition(5), **kw) == brute(rows, **kw)


def test_full_buckets_change_nothing(spark):
    """So few buckets that every bit is set by chance."""
    rows = texts(2, 200)
    want = brute(rows, support=8)
    assert run(spark.createDataFrame(rows, "lang string, text string"), support=8, buckets=1 << 16) == want and want


def test_buckets_prune(spark):
    """Of phrases that occur once nearly none is counted: the buckets of the pass before are below the support."""
    rng = random.Random(4)
    once = " ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(20_000))
    docs = spark.createDataFrame([("en", once + " . " + "left hand . " * 300)], "lang string, text string")
    raw = C.written(C._pass(docs.select("lang", "text"), 1, C.MIN_BUCKETS, "uint8", None, None))
    bits = C._bitmap(raw.where("chunk is not null").select("chunk", "part", "counts"), 8, C.MIN_BUCKETS, "uint8", 100)
    assert np.unpackbits(bits.packed).sum() == 1
    counts = raw.where("chunk is null and phrase is not null").groupBy("lang", "phrase").agg(C.F.sum("n").alias("f")).where("f >= 100")
    assert {r.phrase for r in counts.collect()} >= {"left", "hand"}


@pytest.mark.parametrize("fan_in", [4, 256])
def test_many_tasks_add_up(spark, monkeypatch, fan_in):
    """Bucket counts of 37 tasks, added up in two steps and in one."""
    monkeypatch.setattr(C, "_FAN_IN", fan_in)
    rows = texts(3, 40) * 8
    assert run(spark.createDataFrame(rows, "lang string, text string").repartition(37), support=200) == brute(rows, support=200)


def test_phrases_of_a_slice():
    found = C.Phrases(pa.array(["A b\tC. d", None, "", "É x"]), pa.array(["en", "de", "en", "de"]))
    assert found.texts(found.inside(1), 1).to_pylist() == ["a", "b", "c", "d", "É", "x"] and found.texts(found.inside(2), 2).to_pylist() == ["a b", "b c", "É x"]
    assert found.texts(found.inside(3), 3).to_pylist() == ["a b c"] and found.texts(found.inside(4), 4).to_pylist() == []


def test_large_numbers_stay_exact(spark):
    """1000 * a * n and l * r pass 64 bits."""
    a, n, le, ri = 10**13, 4 * 10**14, 3 * 10**13 + 7, 2 * 10**13 + 1
    row = spark.sql(f"select cast({1000 * a} as decimal(19,0)) * cast({n} as decimal(19,0)) div (cast({le} as decimal(19,0)) * cast({ri} as decimal(19,0))) as s").first()
    assert row.s == 1000 * a * n // (le * ri)


def test_query_on_messy_rows_and_an_empty_table(spark, tmp_path):
    docs = frame(spark, [*messy(7, 30), *[(5000, "again and again it goes. ") for _ in range(120)], (5001, "far away " * 20_000)])
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = queries.queries()["op12_collocations"](spark, str(tmp_path / "a"))
    assert got.columns == names and got.count() > 3
    assert sorted(map(tuple, got.collect())) == sorted(brute([(r.lang, r.text) for r in docs.collect()]))
    assert queries.queries()["op12_collocations"](spark, str(tmp_path / "b")).collect() == []
