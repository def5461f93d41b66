"""The jobs over growing copies of small tables, their command lines, and the registered queries."""

import json
import os
import re
import subprocess
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from jobs import publish_units, queries, translation_queue
from jobs.common import load_config
from quire.errors import ValidationError
from quire.operators import translate

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def docs(folder, name, rows):
    """A file of documents (doc_id, source, lang, text) with a column more than the jobs read."""
    os.makedirs(folder, exist_ok=True)
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array(["x"] * len(rows), pa.string())], names=["doc_id", "source", "lang", "text", "key"]), f"{folder}/{name}.parquet")


FIRST = [(1, "a", "en", "# One\n\nbody"), (2, "a", "de", "same text"), (3, "b", None, "same text"), (4, "b", "", None), (5, None, "fr", " \n\t"), (None, "", "fr", "no id here")]
SECOND = [(6, "a", "en", "same text"), (7, "c", "en", "new text"), (8, "c", "en", "new text"), (0, "b", "es", "# One\n\nbody")]


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "documents"), str(tmp_path / "out"), str(tmp_path / "mark")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_queue_grows_with_its_input(spark, paths):
    documents, out, mark = paths
    docs(documents, "f1", FIRST)
    done = translation_queue.run(spark, documents, out, mark)
    assert (done["batches"], done["documents"], done["queued"]) == (1, 6, 3)
    queued = lambda: rows_of(translation_queue.read_queue(spark, out), "doc_id", "title", "n_docs", "lang", "batch")
    first = queued()
    assert first == sorted([(1, "One", 1, "en", 0), (2, "same text", 2, "de", 0), (None, "no id here", 1, "fr", 0)], key=repr)
    # nothing new: nothing read, nothing written
    assert translation_queue.run(spark, documents, out, mark) == {"batches": 0, "documents": 0, "queued": 0, "cost_usd": 0.0} and queued() == first
    docs(documents, "f2", SECOND)
    done = translation_queue.run(spark, documents, out, mark)
    assert (done["batches"], done["documents"], done["queued"]) == (1, 4, 1)
    assert queued() == sorted([*first, (7, "new text", 2, "en", 1)], key=repr)
    # the key is the one that the library's runs look up
    keyed = translate.keyed(spark.createDataFrame([("new text",)], "markdown string"), "gpt-6-luna", "fr").first().key
    assert translation_queue.read_queue(spark, out).where("doc_id = 7").first().key == keyed


def test_a_batch_that_is_run_again_gives_the_same_rows(spark, paths, monkeypatch):
    """The write of the second batch is done, but the run dies before the stream marks it."""
    documents, out, mark = paths
    docs(documents, "f1", FIRST)
    translation_queue.run(spark, documents, out, mark)
    docs(documents, "f2", SECOND)
    calls = []

    def dies(self):
        calls.append(1)
        raise RuntimeError("killed")

    info = translation_queue.log.info
    monkeypatch.setattr(translation_queue.log, "info", lambda *a: dies(None))
    with pytest.raises(Exception, match="killed"):
        translation_queue.run(spark, documents, out, mark)
    monkeypatch.setattr(translation_queue.log, "info", info)
    before = rows_of(translation_queue.read_queue(spark, out), "*")
    assert calls and len(before) == 4
    assert translation_queue.run(spark, documents, out, mark)["queued"] == 1
    assert rows_of(translation_queue.read_queue(spark, out), "*") == before


def test_files_by_batches_and_what_the_cache_has(spark, paths, tmp_path):
    documents, out, mark = paths
    docs(documents, "f1", FIRST)
    docs(documents, "f2", SECOND)
    cache = translate.keyed(spark.createDataFrame([("new text",)], "markdown string"), "gpt-6-luna", "fr")
    cache.write.parquet(str(tmp_path / "cache"))
    done = translation_queue.run(spark, documents, out, mark, translation_queue.Config(max_files=1, cache=str(tmp_path / "cache")))
    assert done["batches"] == 2 and done["queued"] == 3
    rows = translation_queue.read_queue(spark, out)
    assert rows.count() == rows.select("key").distinct().count() == 3 and rows.where("title = 'new text'").count() == 0


def test_an_empty_folder_is_a_run_without_files(spark, paths):
    documents, out, mark = paths
    docs(documents, "f0", [])
    assert translation_queue.run(spark, documents, out, mark)["queued"] == 0
    docs(documents, "f1", FIRST)
    assert translation_queue.run(spark, documents, out, mark)["queued"] == 3
    assert translation_queue.read_queue(spark, out).count() == 3


def test_publishing_twice_and_a_part_of_it(spark, paths):
    documents, out, _ = paths
    docs(documents, "f1", FIRST)
    done = publish_units.run(spark, documents, out)
    assert done == {"units": 6, "chars": sum(len(t or "") for *_, t in FIRST), "projects": 3}
    units = lambda: rows_of(publish_units.read_units(spark, out), "source", "pos", "doc_id", "unit_id", "title", "prev_id", "next_id", "lang")
    told = lambda: rows_of(publish_units.read_manifests(spark, out), "source", "title", "language", "n_units", "n_distinct", "n_chars")
    first = units(), told()
    assert first[0] == sorted(
        [
            ("a", 1, 1, "unit-001", "One", None, "unit-002", "en"), ("a", 2, 2, "unit-002", "same text", "unit-001", None, "de"), ("b", 1, 3, "unit-001", "same text", None, "unit-002", "und"), ("b", 2, 4, "unit-002", "Untitled", "unit-001", None, "und"),
            ("unsorted", 1, None, "unit-001", "no id here", None, "unit-002", "fr"), ("unsorted", 2, 5, "unit-002", "Untitled", "unit-001", None, "fr"),
        ], key=repr,
    )
    assert first[1] == [("a", "One", "de", 2, 2, 20), ("b", "same text", "und", 2, 2, 9), ("unsorted", "no id here", "fr", 2, 2, 13)]
    publish_units.run(spark, documents, out)
    assert (units(), told()) == first
    # a part: only its projects are replaced
    docs(documents, "f2", SECOND)
    assert publish_units.run(spark, documents, out, publish_units.Config(sources=["c", "a"]))["projects"] == 2
    assert [u for u in units() if u[0] in ("b", "unsorted")] == [u for u in first[0] if u[0] in ("b", "unsorted")]
    assert [u[1:3] for u in units() if u[0] == "a"] == [(1, 1), (2, 2), (3, 6)] and len([u for u in units() if u[0] == "c"]) == 2
    assert ("a", "One", "en", 3, 2, 29) in told() and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_an_empty_table_publishes_nothing(spark, paths):
    documents, out, _ = paths
    docs(documents, "f0", [])
    assert publish_units.run(spark, documents, out) == {"units": 0, "chars": 0, "projects": 0}


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"model": "gpt-6-luna", "to": "FR-ca", "spark": {"spark.sql.shuffle.partitions": 3}}))
    config, spark = load_config(translation_queue.Config, str(path))
    assert config.to == "fr-ca" and spark == {"spark.sql.shuffle.partitions": "3"}
    path.write_text('{"speed": 1}')
    with pytest.raises(ValidationError, match="speed"):
        load_config(publish_units.Config, str(path))
    for bad in ({"model": "none"}, {"to": "?"}, {"max_files": 0}):
        with pytest.raises(ValidationError):
            translation_queue.Config(**bad)
    for name, kind in (("translation_queue", translation_queue.Config), ("publish_units", publish_units.Config)):
        assert load_config(kind, f"{ROOT}/jobs/{name}.json")[0] == kind()


@pytest.mark.parametrize("name", ["translation_queue", "publish_units"])
def test_command_lines(name, paths, tmp_path):
    documents, out, mark = paths
    docs(documents, "f1", FIRST)
    (tmp_path / "c.json").write_text(json.dumps({"spark": {"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": 2, "spark.checkpoint.dir": f"file://{tmp_path}/shared"}}))
    extra = ["--checkpoint", mark] if name == "translation_queue" else []
    run = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--config", str(tmp_path / "c.json"), "--documents", documents, "--output", out, *extra], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert re.search("read 6 documents" if extra else "wrote 6 units and 3 manifests", run.stderr)
    assert any(f.endswith(".parquet") for _, _, files in os.walk(out) for f in files)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_jobs_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda names, rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[names.index(c)] for c in sorted(names))) for r in rows), key=repr)
    assert key(df.columns, [tuple(r) for r in df.collect()]) == key(want.columns, want.fetchall())
    again = queries.queries()[name](spark, sf_dir)
    assert again.count() == df.count()  # a folder of its own
