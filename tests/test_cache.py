import os

import pytest

from quire import schemas
from quire.errors import EngineError
from quire.operators import translate
from quire.sources import cache, project


def rows(spark, *pairs):
    return spark.createDataFrame([(k, "unit-001", text, "T", (1, 2, 3), 0.5, 7, "m") for k, text in pairs], schemas.CACHE)


def held(df):
    return {r.key: (r.markdown, r.segment) for r in df.collect()}


def test_runs_append_their_own_keys(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.read(spark, path).count() == 0 and cache.newest(cache.read(spark, path)).count() == 0
    assert cache.append(rows(spark, ("a", "1"), ("b", "1")), path) == 0
    before = {f: os.path.getmtime(f"{path}/segment=0/{f}") for f in os.listdir(f"{path}/segment=0")}
    assert cache.append(rows(spark, ("b", "2"), ("c", "2")), path) == 1
    assert {f: os.path.getmtime(f"{path}/segment=0/{f}") for f in os.listdir(f"{path}/segment=0")} == before
    assert cache.read(spark, path).where("segment = 1").count() == 2
    assert held(cache.newest(cache.read(spark, path))) == {"a": ("1", 0), "b": ("2", 1), "c": ("2", 1)}
    wanted = spark.createDataFrame([("b",), ("b",), ("x",)], "key string")
    assert held(cache.newest(cache.read(spark, path), wanted)) == {"b": ("2", 1)}
    # a segment that is written again replaces itself
    assert cache.append(rows(spark, ("b", "3")), path, segment=1) == 1
    assert held(cache.newest(cache.read(spark, path))) == {"a": ("1", 0), "b": ("3", 1)}


def test_compaction_keeps_what_holds(spark, tmp_path):
    path = str(tmp_path / "cache")
    for n in range(4):
        cache.append(rows(spark, ("a", str(n)), (f"k{n}", "x")), path)
    assert cache.compact(spark, path) == 3
    assert held(cache.read(spark, path)) == {"a": ("3", 0)} | {f"k{n}": ("x", 0) for n in range(4)} and os.listdir(tmp_path) == ["cache"]
    assert cache.append(rows(spark, ("a", "4")), path) == 1


def test_tables_of_other_kinds(spark, tmp_path):
    plain = str(tmp_path / "plain")
    rows(spark, ("a", "1")).write.parquet(plain)
    assert held(cache.read(spark, plain)) == {"a": ("1", 0)}
    assert cache.append(rows(spark, ("b", "2")), plain) == 1
    assert held(cache.newest(cache.read(spark, plain))) == {"a": ("1", 0), "b": ("2", 1)}
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    spark.range(3).write.parquet(str(tmp_path / "other"))
    assert cache.read(spark, str(tmp_path / "broken")).count() == 0 and cache.read(spark, str(tmp_path / "other")).count() == 0


def test_a_swap_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    cache.append(rows(spark, ("a", "1")), path)

    class Store:
        def __init__(self, real):
            self.real, self.n = real, 0

        def exists(self, p):
            return self.real.exists(p)

        def rename(self, a, b):
            self.n += 1
            return False if self.n == 2 else self.real.rename(a, b)  # the new table cannot take the place

        def delete(self, p, deep):
            raise AssertionError("not reached")

    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    real = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = Store(real)
    monkeypatch.setattr(project, "_store", lambda spark, at: made)
    with pytest.raises(EngineError) as e:
        cache.compact(spark, path)
    assert e.value.code == "write-failed" and made.n == 3
    assert held(cache.read(spark, path)) == {"a": ("1", 0)}


def test_merged_cache(spark):
    got = translate.merged_cache(rows(spark, ("a", "1"), ("b", "1")), rows(spark, ("b", "2"), ("c", "2")))
    assert got.columns == [f.name for f in schemas.schema(schemas.CACHE).fields]
    assert {r.key: r.markdown for r in got.collect()} == {"a": "1", "b": "2", "c": "2"}
