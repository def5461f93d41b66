"""Every registered query against its DuckDB SQL on the smallest tables, and the driver contract."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    got = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(got.columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_have_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_unchanged_structure_is_valid(spark, sf_dir):
    out = catalogue.queries()["structure_validation"](spark, sf_dir).select("page_id", "ok").collect()
    assert all(r.ok == (r.page_id % 3 != 0) for r in out)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "pos", "unit_id", "title", "path", "prev_id", "next_id"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_everything_else_works_without_the_training_part(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'units_navigation' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op1')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
    found = subprocess.run(["grep", "-rlE", r"(quire|\.+)\.?llm|corpus_pipeline", str(copy / "quire"), "--include=*.py"], capture_output=True, text=True).stdout
    assert not found


def test_translate_echo_runs_every_project(spark, sf_dir, con):
    got = catalogue.queries()["translate_echo"](spark, sf_dir).collect()
    counts = {r.source: r.translated + r.cached + r.failed + r.skipped for r in got}
    assert len(got) == len(counts) > 1 and counts == dict(con.sql("select source, count(*) from documents group by 1").fetchall())
