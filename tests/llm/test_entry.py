"""Registration, SQL on the smallest tables, and the pipeline against a plain version of it."""

import hashlib
import math
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from quire.llm import queries, toxicity

from .common import PIECES, messy
from .test_lines_mixing import brute as clean_lines
from .test_minhash import brute as components
from .test_toxicity import corpus


def test_registered_queries():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 13))
    assert entry.queries()["pipeline"] is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def cell(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    pick = lambda names, data: sorted((tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in data), key=repr)
    assert pick(df.columns, [tuple(r) for r in df.collect()]) == pick(want.columns, want.fetchall())


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = {i: t for i, t in messy(11, 40) if i is not None}
    toxic = {10_000 + i: (t, y) for i, t, y in corpus(240)}
    rows |= {i: t for i, (t, _) in toxic.items()}
    ids = list(rows)
    docs = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array([rows[i] for i in ids], pa.string()), "lang": ["en"] * len(ids), "source": [f"s{i % 3}" for i in ids], "n_chars": pa.array([None if rows[i] is None else len(rows[i]) for i in ids], pa.int64())}
    pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(list(toxic), pa.int64()), "quality": [1] * len(toxic), "toxic": [y for _, y in toxic.values()]}), tmp_path / "labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    # the same, plainly: the model is a fit of its own and is taken as it is
    model = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    words = toxicity.tokens(pa.array([rows[i] for i in ids], pa.large_string()))
    score = dict(zip(ids, model.scores(words, model.token_marginals(words))))
    assert all((score[i] >= 0.3) == bool(y) for i, (_, y) in toxic.items())
    kept = [(i, rows[i]) for i in ids if score[i] < 0.3]
    cleaned = [(i, t) for (i, before), t in zip(kept, clean_lines(kept, 3)) if t == before or (t or "").strip(" \t\n\r\x0b\x0c")]
    groups = components(cleaned, 80)
    last = {i: t for i, t in cleaned if groups[i][1] == i}
    assert got.keys() == last.keys() and len(last) < len(cleaned) < len(kept) < len(ids)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, t in last.items():
        x = sp.encode(t or "", add_eos=True)
        assert list(got[i].ids) == x and got[i].decoded_sha256 == hashlib.sha256(sp.decode(x).encode()).hexdigest()


def test_mixing_stage_orders_the_table(spark, tmp_path):
    from quire.llm import mixing

    rows = [(i, "word " * 300, "en", f"s{i % 4 if i % 3 else 0}", 1500) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mixing_stage(spark, docs, "")
    assert out.columns == docs.columns
    out.write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    read = [i for f in files for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mix(docs).collect()}
    assert sorted(read) == list(range(400)) and [place[i] for i in read] == sorted(place.values())


def test_pipeline_returns_the_mixed_order(spark, tmp_path, monkeypatch):
    from quire.llm import mixing

    # files of very different sizes, which a reader takes up largest first
    rows = [(i, f"word {i} " * (900 if i % 5 == 0 else 20), "en", f"s{i % 4 if i % 3 else 0}", 1500) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    got = corpus_pipeline.run(spark, str(tmp_path))
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mix(docs).collect()}
    found = [r.doc_id for r in got.orderBy("position").collect()]
    assert sorted(found) == list(range(300)) and [place[i] for i in found] == sorted(place.values())
    assert got.select("position").distinct().count() == len(rows)
