"""Files that are written by tasks and read back, hidden and broken ones among them."""

import os
import pickle
import tracemalloc

import pytest

from patternlake.sources import filetree, metadata


@pytest.fixture
def tree(tmp_path):
    files = {
        "a.txt": b"plain",
        "empty": b"",
        ".hidden/x.txt": "é".encode(),
        ".dot": b"dot",
        "_under/deep/er/y": b"bad \xff\xfe end",
        "deep/1/2/3/z": b"\xe2\x82 cut",
        "big": b"x" * 3_000_000,
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (tmp_path / "nothing here").mkdir()
    return tmp_path, {str(tmp_path / n): c for n, c in files.items()}


@pytest.mark.parametrize("tasks", [1, 2, 64])
def test_every_file_is_read_once(spark, tree, tasks):
    root, files = tree
    got = filetree.read_tree(spark, str(root), tasks).collect()
    assert {r.path: (r.length, r.content) for r in got} == {p: (len(c), c.decode("utf-8", "replace")) for p, c in files.items()}
    assert len(got) == len(files)


def test_uri_and_scan(spark, tree):
    root, files = tree
    assert filetree.read_tree(spark, f"file://{root}").count() == len(files)
    (root / "classes").mkdir()
    (root / "classes" / "A.cls").write_bytes(b"class A \xff")
    rows = metadata.scan(spark, str(root), "src").where("file_type = 'apex'").collect()
    assert [(r.name, r.content) for r in rows] == [("A.cls", "class A �")]


def test_wide_folders_are_dealt_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(filetree, "TASK_BYTES", 50_000)
    for k in range(40):
        (tmp_path / f"f{k}").write_bytes(b"x" * 1000)
    shares = filetree.FileTreeReader(str(tmp_path), 8).partitions()
    assert len(shares) == 4 and sorted(f[0] for s in shares for f in s.files) == sorted(str(tmp_path / f"f{k}") for k in range(40))


def test_the_driver_holds_some_bytes_for_a_file(tmp_path):
    """Neither a wide folder nor what was listed is held entry by entry; folders without end don't make as many tasks."""
    (tmp_path / "wide").mkdir()
    (tmp_path / "many").mkdir()
    for k in range(10_000):
        (tmp_path / "wide" / f"SomeLongNameOfAClass{k}.cls").touch()
    for k in range(3000):
        (tmp_path / "many" / f"f{k}").mkdir()
    reader = filetree.FileTreeStreamReader(str(tmp_path), 0)

    def peak(work):
        tracemalloc.start()
        try:
            return work(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    end, held = peak(reader.latestOffset)
    assert held < 200_000
    shares, held = peak(lambda: reader.partitions({"changed": -1}, end))
    assert len({f[0] for s in shares for f in s.files}) == 10_000
    assert sum(len(pickle.dumps(s)) for s in shares) < 400_000
    (tmp_path / "many" / "f7" / "x").touch()
    shares = filetree.FileTreeReader(str(tmp_path), 8).partitions()
    assert len(shares) < 200 and len({f for s in shares for f in s.folders}) == 3000
    assert len({row for s in shares for batch in filetree._read(str(tmp_path), s) for row in batch["path"].to_pylist()}) == 10_001


def test_missing_and_vanished(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        filetree.read_tree(spark, str(tmp_path / "none")).collect()
    assert filetree.read_tree(spark, str(tmp_path)).collect() == []
    reader = filetree.FileTreeReader(str(tmp_path), 1)
    gone = filetree.Share([(str(tmp_path / "gone"), 5, 1_000_000)], [str(tmp_path / "gone too")])
    (batch,) = reader.read(gone)
    assert [(r["path"], r["length"], r["content"]) for r in batch.to_pylist()] == [(str(tmp_path / "gone"), 5, "")]


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", b"1\xff"), (".h/c", None)], "path string, content binary").repartition(2)
    assert filetree.write_files(rows, str(tmp_path / "out")) == 2
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"1\xff" and os.path.getsize(tmp_path / "out/.h/c") == 0
    assert filetree.write_files(rows.where("false"), str(tmp_path / "out")) == 0


def test_stream_offsets(tmp_path):
    """Every change is in one batch; what has just changed waits."""
    reader = filetree.FileTreeStreamReader(str(tmp_path), 0)
    assert reader.latestOffset() == reader.initialOffset()

    def batch(start):
        end = reader.latestOffset()
        return end, sorted(os.path.basename(f[0]) for share in reader.partitions(start, end) for f in share.files)

    for name, at in (("a", 10), ("b", 20)):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (at, at))
    end, names = batch(reader.initialOffset())
    assert names == ["a", "b"] and batch(end)[1] == []
    os.utime(tmp_path / "a", (30, 30))
    (tmp_path / ".c").write_text("now")
    slow = filetree.FileTreeStreamReader(str(tmp_path), 3600)
    assert slow.latestOffset() == {"changed": 30 * 10**9}
    assert batch(end)[1] == [".c", "a"]
