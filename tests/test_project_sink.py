import json
import os

import pytest
from pyspark.sql import functions as F

from quire.errors import ValidationError
from quire.operators import manifest as M
from quire.plans import made
from quire.sources import project, project_sink


def files(spark, rows):
    return spark.createDataFrame([(d, p, c.encode()) for d, p, c in rows], project_sink.FILES).repartition(5)


def tree(folder):
    return {os.path.relpath(os.path.join(top, n), folder): open(os.path.join(top, n)).read() for top, _, names in os.walk(folder) for n in names}


def test_projects_are_written_from_tasks(spark, tmp_path):
    rows = [(f"d{i}", f"chapters/{k}.md", f"{i}/{k} é") for i in range(4) for k in range(9)] + [(f"d{i}", "manifest.json", "{}") for i in range(4)]
    project_sink.write_projects(files(spark, rows), str(tmp_path / "lib"))
    assert tree(tmp_path / "lib") == {f"{d}/{p}": c for d, p, c in rows}
    # a project that has content refuses all, unless forced; then it is replaced as a whole and others stay
    again = [("d1", "manifest.json", "new"), ("e", "manifest.json", "{}")]
    with pytest.raises(ValidationError, match="d1"):
        project_sink.write_projects(files(spark, again), str(tmp_path / "lib"))
    project_sink.write_projects(files(spark, again), str(tmp_path / "lib"), force=True)
    assert tree(tmp_path / "lib") == {f"{d}/{p}": c for d, p, c in rows if d != "d1"} | {"d1/manifest.json": "new", "e/manifest.json": "{}"}


@pytest.mark.parametrize("bad", ["../out.md", "/etc/x.md", "chapters/../../x"])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    lib = tmp_path / "lib"
    project_sink.write_projects(files(spark, [("a", "manifest.json", "old")]), str(lib))
    with pytest.raises(Exception, match="must stay inside"):
        project_sink.write_projects(files(spark, [("a", "manifest.json", "new"), ("b", "manifest.json", "x"), ("a", bad, "y")]), str(lib), force=True)
    assert tree(lib) == {"a/manifest.json": "old"} and sorted(os.listdir(lib)) == ["a"] and sorted(os.listdir(tmp_path)) == ["lib"]
    with pytest.raises(Exception, match="Invalid document name"):
        project_sink.write_projects(files(spark, [("../c", "manifest.json", "x")]), str(lib), force=True)
    assert sorted(os.listdir(tmp_path)) == ["lib"]


def test_a_task_that_runs_twice_does_no_harm(tmp_path, monkeypatch):
    class Task:
        n = 0

        @classmethod
        def get(cls):
            cls.n += 1
            return type("T", (), {"taskAttemptId": lambda self: cls.n})()

    monkeypatch.setattr(project_sink, "TaskContext", Task)
    w = project_sink._Writer(str(tmp_path))
    rows = [("a", "manifest.json", b"1"), ("a", "chapters/1.md", b"2")]
    lost = f"{w.staging}/a"
    os.makedirs(lost + "/chapters")
    open(f"{lost}/chapters/1.md.{w.tag}-99", "w").write("half")  # an attempt that was killed
    first, second = w.write(iter(rows)), w.write(iter(rows))
    assert not os.path.exists(tmp_path / "a")
    w.commit([first, second, None])
    assert tree(tmp_path) == {"a/manifest.json": "1", "a/chapters/1.md": "2"} and os.listdir(tmp_path) == ["a"]
    # a task that is late writes nothing behind an abort
    late = project_sink._Writer(str(tmp_path))
    late.write(iter(rows))
    late.abort([])
    with pytest.raises(FileNotFoundError):
        late.write(iter(rows))
    late.abort([])
    assert os.listdir(tmp_path) == ["a"]


def test_swap_brings_the_old_folder_back(tmp_path, monkeypatch):
    for n in ("new", "old"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "f").write_text(n)
    rename = os.rename

    def fails(a, b):
        if a.endswith("/new"):
            raise OSError("disk")
        rename(a, b)

    monkeypatch.setattr(os, "rename", fails)
    with pytest.raises(OSError):
        project.swap(str(tmp_path / "new"), str(tmp_path / "old"))
    assert (tmp_path / "old" / "f").read_text() == "old" and sorted(os.listdir(tmp_path)) == ["new", "old"]
    monkeypatch.setattr(os, "rename", rename)
    project.swap(str(tmp_path / "new"), str(tmp_path / "old"))
    assert (tmp_path / "old" / "f").read_text() == "new" and os.listdir(tmp_path) == ["old"]


def test_manifest_files_and_asset_paths(spark, tmp_path):
    place = F.struct(F.lit("b.epub").alias("source_path"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("spine_index"), F.lit(None).cast("string").alias("selector"), F.lit(None).cast("double").alias("confidence"))
    units = spark.createDataFrame([("d", 1, "unit-001", "É", "chapters/001-e.md", None)], "document_id string, pos int, unit_id string, title string, path string, markdown string").withColumn("source", place)
    assets = spark.createDataFrame([("d", "asset-001", "assets/images/a.png", bytearray(b"\x89P"), "image/png", None, 3.0, 4.5)], "document_id string, asset_id string, path string, bytes binary, mime_type string, alt_text string, width double, height double")
    documents = spark.createDataFrame([("d", "T", "ar", "epub", "b.epub", 9)], "document_id string, title string, language string, format string, path string, size long")
    reports = spark.createDataFrame([("d", "n.md", "hello")], "document_id string, name string, text string")
    made = project_sink.project_files(M.create(documents, units, assets), units, assets, reports, {"print.css": "own"})
    project_sink.write_projects(made, str(tmp_path))
    m = json.loads((tmp_path / "d/manifest.json").read_text())
    assert m["source"]["size"] == 9 and isinstance(m["source"]["size"], int) and m["units"][0]["title"] == "É" and m["assets"][0]["height"] == 4.5 and m["direction"] == "rtl" and "altText" not in m["assets"][0]
    assert (tmp_path / "d/templates/print.css").read_text() == "own" and (tmp_path / "d/reports/n.md").read_text() == "hello" and (tmp_path / "d/chapters/001-e.md").read_text() == "" and (tmp_path / "d/assets/images/a.png").read_bytes() == b"\x89P"
    with pytest.raises(Exception, match="must be under assets"):
        project_sink.write_projects(project_sink.project_files(M.create(documents, units, assets), units, assets.withColumn("path", F.lit("elsewhere"))), str(tmp_path / "x"))
    assert not os.path.exists(tmp_path / "x") or os.listdir(tmp_path / "x") == []


def test_tasks_put_projects_in_place_and_go_on_where_one_was_lost(spark, tmp_path, monkeypatch):
    """The driver swaps no project and hears no names; a bucket taken again, also in the middle of a swap, is finished."""
    monkeypatch.setattr(project_sink, "swap", None)  # on the driver only
    lib = tmp_path / "lib"
    rows = [(f"d{i}", f"chapters/{k}.md", f"{i}/{k}") for i in range(30) for k in range(3)]
    for again in ("", "x"):
        project_sink.write_projects(files(spark, [(d, p, c + again) for d, p, c in rows]), str(lib), force=True)
        assert tree(lib) == {f"{d}/{p}": c + again for d, p, c in rows} and not [n for n in os.listdir(lib) if n.startswith(".")]
    monkeypatch.undo()
    staging = lib / ".tmp-t"
    (staging / "00" / "d1").mkdir(parents=True)
    (staging / "00" / "d1" / "f.t-3").write_text("half")
    (staging / "00" / "d1" / "f").write_text("new")
    (staging / "old" / "00").mkdir(parents=True)
    os.rename(lib / "d1", staging / "old" / "00" / ("d1-" + "0" * 32))  # lost between the two renames
    assert project_sink.settle(str(lib), str(staging), "00") == 1 and project_sink.settle(str(lib), str(staging), "00") == 0
    os.rename(lib / "d2", staging / "old" / "00" / ("d2-" + "0" * 32))  # lost for good
    project_sink._undo(str(lib), str(staging))
    found = tree(lib)
    assert {n for n in found if n.startswith("d1/")} == {"d1/f"} and found["d1/f"] == "new" and found["d2/chapters/0.md"] == "2/0x" and not os.path.exists(staging)


def test_projects_are_read_by_tasks(spark, tmp_path):
    """Every file of every project comes back, hidden and odd names too; what is beside the projects does not."""
    lib = tmp_path / "lib"
    rows = [("big", f"chapters/{k}.md", f"{k} é") for k in range(200)] + [("_a b", "x%20 é/.hidden/_SUCCESS", ""), (".c", "deep/er/1=2.md", "z"), ("old", ".tmp", "t")]
    project_sink.write_projects(files(spark, rows), str(lib))
    (lib / "beside.txt").write_text("no")
    (lib / (".tmp-" + "0" * 32) / "00" / "d").mkdir(parents=True)  # of a run that is not done
    (lib / (".tmp-" + "0" * 32) / "00" / "d" / "f").write_text("no")
    (lib / "empty" / "chapters").mkdir(parents=True)
    read = project_sink.read_projects(spark, str(lib))
    assert sorted((r.document_id, r.path, bytes(r.content).decode()) for r in read.collect()) == sorted(rows)
    assert read.where("document_id = 'big'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 100
    os.symlink(lib / "beside.txt", lib / "big" / "link")
    with pytest.raises(Exception, match="Only files and folders"):
        project_sink.read_projects(spark, str(lib)).collect()


def test_what_a_task_reads_at_once_is_bounded(monkeypatch):
    monkeypatch.setattr(project_sink, "_BYTES", 10)
    monkeypatch.setattr(project_sink, "_ROWS", 3)
    sizes = [4, 4, 4, 25, 0, 0, 0, 0, 10]
    found = list(project_sink._batches((("d", "p", b"x" * n) for n in sizes), ("document_id", "path", "content")))
    assert [[len(x) for x in b.column(2).to_pylist()] for b in found] == [[4, 4], [4], [25], [0, 0, 0], [0, 10]]
    assert list(project_sink._batches([], ("document_id",))) == []


def test_the_driver_holds_no_names_of_project_files(spark, sf_dir):
    """Spark's own reader of files listed all of them on the driver, about 1 KB each."""
    assert made.queries()["project_folders"](spark, sf_dir).inputFiles() == []
