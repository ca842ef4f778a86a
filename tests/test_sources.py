"""Scanning, chunking, the index and its updates, streams and the command line, on a tree in a temporary folder."""

import json
import os

import pytest

from fathom import cli
from fathom.sources.extract import extract_chunks, scan
from fathom.sources.index import Index, diff_files
from fathom.streaming import updates

A = '''import os, sys as s
from .b import helper as h

@deco(1)
def top(x):
    def inner():
        pass
    return h(x) + os.path.join("a")


class Box(Base):
    @property
    async def open(self):
        self.store.put(top)
        return self.close()

    def close(self): pass
'''


def write(root, files):
    for name, body in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body if isinstance(body, bytes) else body.encode())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    write(root, {"pkg/a.py": A, "pkg/b.py": "def helper(y):\n    return y\n", "pkg/bad.py": "def f(:\n", "pkg/raw.py": b"x = '\xff'\n", "node_modules/c.py": "def c(): pass\n", ".pytest_tmp9/d.py": "", "notes.txt": "x"})
    return root


def test_scan(spark, tree):
    rows = {r.rel_path: r for r in scan(spark, str(tree)).collect()}
    assert set(rows) == {"pkg/a.py", "pkg/b.py", "pkg/bad.py", "pkg/raw.py"} and rows["pkg/raw.py"].source == "x = '�'\n"
    with pytest.raises(FileNotFoundError):
        scan(spark, str(tree / "none"))
    with pytest.raises(NotADirectoryError):
        scan(spark, str(tree / "notes.txt"))


def test_chunks(spark, tree):
    rows = {(r.file_path, r.name): r for r in extract_chunks(scan(spark, str(tree))).collect()}
    assert set(rows) == {("pkg/a.py", "top"), ("pkg/a.py", "Box"), ("pkg/a.py", "open"), ("pkg/a.py", "close"), ("pkg/b.py", "helper")}
    top, box, open_ = rows["pkg/a.py", "top"], rows["pkg/a.py", "Box"], rows["pkg/a.py", "open"]
    assert (top.start_line, top.end_line, top.decorators, top.imports) == (4, 8, ["@deco(1)"], ["import os, sys as s", "from .b import helper as h"])
    assert {"h", "os.path.join", "join", "deco"} <= set(top.dependencies)
    assert box.chunk_type == "class" and box.dependencies == [] and open_.parent == "Box" and {"self.store.put", "put", "store.put", "top", "self.close", "close"} <= set(open_.dependencies)


def test_index_life(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    assert index.compatibility() == "missing"
    first = index.update(scan(spark, str(tree)))
    assert first["rebuilt"] and first["files_indexed"] == 4 and first["chunks_indexed"] == 5 and index.compatibility() == "compatible"
    ids = {r.id for r in index.chunks().collect()}
    (tree / "pkg/b.py").write_text("def helper(y):\n    return y\n\n\ndef more():\n    pass\n")
    os.remove(tree / "pkg/raw.py")
    write(tree, {"pkg/new.py": "def fresh(): pass\n"})
    second = index.update(scan(spark, str(tree)))
    assert (second["new"], second["changed"], second["unchanged"], second["deleted"], second["rebuilt"]) == (1, 1, 2, 1, False)
    now = {r.id for r in index.chunks().collect()}
    assert len(now) == 7 and len(now & ids) == 5 and second["created_at"] == first["created_at"]
    assert Index(spark, str(tmp_path / "index"), model="other").compatibility() == "outdated"
    assert index.update(scan(spark, str(tree)), rebuild=True)["rebuilt"]


def test_diff_counts_missing_digests_as_changed(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("n", "1")], "rel_path string, sha256 string")
    old = spark.createDataFrame([("a", "1"), ("b", ""), ("c", None), ("d", "1")], "rel_path string, sha256 string")
    assert {(r.rel_path, r.status) for r in diff_files(now, old).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "changed"), ("n", "new"), ("d", "deleted")}


def test_streamed_files(spark, tmp_path):
    schema = "repo string, rel_path string, source string, sha256 string"
    at = str(tmp_path / "in")
    run = lambda rows: (spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at), updates.stream_chunks(spark.readStream.schema(schema).parquet(at), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination())
    run([("r", "a.py", "def f(): pass\n", "1"), ("r", "a.py", "def f(): pass\n", "1"), ("r", "b.py", "def k(): pass\n", "2")])
    run([("r", "a.py", "def g(): pass\ndef h(): pass\n", "3")])
    rows = updates.latest_chunks(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert sorted(r.name for r in rows) == ["g", "h", "k"]
    run([("r", "a.py", "# emptied\n", "4"), ("r", "b.py", None, None), ("q", "a.py", "def other(): pass\n", "5")])
    assert [r.name for r in updates.latest_chunks(spark.read.parquet(str(tmp_path / "out"))).collect()] == ["other"]
    run([("r", "b.py", "def broken(:\n", "6"), (None, "c.py", "def c(): pass\n", "7")])
    assert sorted(r.name for r in updates.latest_chunks(spark.read.parquet(str(tmp_path / "out"))).collect()) == ["c", "other"]


def test_folders_of_intermediate_tables(spark):
    from types import SimpleNamespace

    from fathom.sources import tables

    df = tables.settle(spark.range(3))
    assert df.count() == 3 and tables.remove_tables() >= 1 and tables.remove_tables() == 0
    unset = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: other), sparkContext=SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: unset)))
    assert "/x-" in tables.shared_folder(session("local[4]"), "x")
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError):
            tables.shared_folder(session(master), "x")


def test_command_line(spark, tree, tmp_path, capfd):
    assert cli.main(["scan", str(tree)], spark) == 0 and "4 files" in capfd.readouterr().out
    assert cli.main(["scan", str(tree / "none")], spark) == 2
    assert cli.main(["investigate", str(tree), "helper", "--json"], spark) == 2
    assert json.loads(capfd.readouterr().out)["status"] == "error"
    assert cli.main(["index", str(tree)], spark) == 0
    capfd.readouterr()
    assert cli.main(["investigate", str(tree), "helper returns the wrong value", "--json"], spark) == 0
    said = json.loads(capfd.readouterr().out)
    assert said["status"] == "ok" and said["likely_relevant_code"]
    log = tmp_path / "log.txt"
    log.write_text("____________ test_helper ____________\nE   assert 1 == 2\ntests/test_b.py:3: AssertionError\nFAILED tests/test_b.py::test_helper - assert 1 == 2\n")
    assert cli.main(["test", str(tree), "--log", str(log)], spark) == 1 and "AssertionError" in capfd.readouterr().out
