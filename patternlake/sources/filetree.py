"""A data source for trees of text files, and a sink that writes rows as files.

    spark.read.format("filetree").load(root)
    spark.readStream.format("filetree").load(root)

reads every regular file under a root, also hidden ones and those in hidden folders, which
Spark's own sources leave out. The text is UTF-8; bytes that aren't become the replacement
character, as Python puts it; a file that can't be read any more has the empty text.

The tree is listed level by level on the driver just until it has folders for all tasks; each
task lists its own folders and reads what it finds. Files of the listed levels are dealt by size.
What the driver has listed it holds packed, some bytes for a file. Local folders are listed entry
by entry; of other file systems one folder's entries are held at once.
Any file system that pyarrow.fs knows by its URI will do (local, s3, gs, hdfs).

A stream has each file when it is new and again whenever it has changed, by its time of change (Spark's
own file stream knows a path once and for all). Changes of the last `settle` seconds wait for a
later batch, as a store may round times or show a file late.
"""

from __future__ import annotations

import itertools
import os
import pickle
import time
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, length long, modified timestamp, content string"
#: Bytes of a batch and of a task's listed files, and folders that the driver lists for, by default; shares of folders for each of these, at most.
BATCH_BYTES, TASK_BYTES, TASKS, SHARES = 4 << 20, 32 << 20, 64, 16
#: Seconds that a stream leaves a changed file alone.
SETTLE = 2


def _system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root, and the root's path there."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    root = root.rstrip("/") or "/"
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


#: A file: path, length, and time of change in nanoseconds.
File = tuple[str, int, int]
_KINDS = [("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.string())]


class Share(InputPartition):
    """What a task reads: listed files, and folders whose trees it lists itself. They are packed, as the driver holds all tasks' shares."""

    def __init__(self, files: list[File], folders: list[str]):
        self.packed = zlib.compress(pickle.dumps(([*zip(*files)], folders)))

    def _unpacked(self) -> tuple[list[tuple], list[str]]:
        return pickle.loads(zlib.decompress(self.packed))

    @property
    def files(self) -> list[File]:
        return [*zip(*self._unpacked()[0])]

    @property
    def folders(self) -> list[str]:
        return self._unpacked()[1]


def _entries(system: fs.FileSystem, folder: str, must_exist: bool = False) -> Iterator[File | str]:
    """The files in a folder, and the paths of its folders."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=not must_exist)):
            if info.type == fs.FileType.Directory:
                yield info.path
            elif info.type == fs.FileType.File:
                yield info.path, info.size or 0, info.mtime_ns or 0
        return
    try:
        listed = os.scandir(folder)
    except FileNotFoundError:
        if must_exist:
            raise
        return
    with listed:
        for entry in listed:
            if entry.is_dir():
                yield entry.path
            elif entry.is_file():
                try:
                    found = entry.stat()
                except FileNotFoundError:
                    continue
                yield entry.path, found.st_size, found.st_mtime_ns


def _every(system: fs.FileSystem, folders: list[str]) -> Iterator[File]:
    open_folders = [iter(folders)]
    while open_folders:
        for found in open_folders[-1]:
            if isinstance(found, str):
                open_folders.append(_entries(system, found))
                break
            yield found
        else:
            open_folders.pop()


def _dealt(files: Iterable[File]) -> list[Share]:
    shares, held, weight = [], [], 0
    for file in files:
        held.append(file)
        weight += file[1] + 4096  # opening a file takes time too
        if weight >= TASK_BYTES:
            shares.append(Share(sorted(held), []))
            held, weight = [], 0
    return [*shares, Share(sorted(held), [])] if held else shares


def _read(root: str, share: Share) -> Iterator[pa.RecordBatch]:
    system, _ = _system(root)
    rows: list[tuple] = []
    size = 0
    for path, length, changed in itertools.chain(share.files, _every(system, share.folders)):
        try:
            with system.open_input_stream(path) as stream:
                content = stream.read()
        except OSError:
            content = b""
        rows.append((path, length, changed // 1000, content.decode("utf-8", "replace")))
        size += length + 100
        if size >= BATCH_BYTES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_KINDS)], [n for n, _ in _KINDS])


class FileTreeReader(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self) -> list[Share]:
        system, top = _system(self.root)
        level, shares = [top], []
        while level and (level == [top] or len(level) < self.tasks):
            below: list[str] = []
            shares += _dealt(self._files(system, level, level == [top], below))
            level = below
        level.sort()
        step = max(1, -(-len(level) // (SHARES * self.tasks)))
        return [Share([], level[i : i + step]) for i in range(0, len(level), step)] + shares or [Share([], [])]

    @staticmethod
    def _files(system: fs.FileSystem, folders: list[str], must_exist: bool, below: list[str]) -> Iterator[File]:
        """The files in some folders; `below` gets the folders in these."""
        for folder in folders:
            for found in _entries(system, folder, must_exist):
                if isinstance(found, str):
                    below.append(found)
                else:
                    yield found

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        return _read(self.root, share)


class FileTreeStreamReader(DataSourceStreamReader):
    """Offsets are times of change; a batch has the files that changed after one and not after the next."""

    def __init__(self, root: str, settle: float):
        self.root, self.settle = root, settle

    def _files(self) -> Iterator[File]:
        system, top = _system(self.root)
        return _every(system, [top])

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        until = int((time.time() - self.settle) * 1e9)
        return {"changed": max((f[2] for f in self._files() if f[2] <= until), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return _dealt(f for f in self._files() if start["changed"] < f[2] <= end["changed"]) or [Share([], [])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        return _read(self.root, share)

    def commit(self, end: dict) -> None:
        pass


class FileTree(DataSource):
    """Options: path; `tasks`, the number of folders to list for; and of a stream `settle`, in seconds."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FileTreeReader:
        return FileTreeReader(self.options["path"], int(self.options.get("tasks", TASKS)))

    def streamReader(self, schema: StructType) -> FileTreeStreamReader:
        return FileTreeStreamReader(self.options["path"], float(self.options.get("settle", SETTLE)))


def read_tree(spark: SparkSession, root: str, tasks: int = TASKS) -> DataFrame:
    """path, length, modified and content of every file under `root`."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("tasks", tasks).load(root)


def watch_tree(spark: SparkSession, root: str, settle: float = SETTLE) -> DataFrame:
    """A stream of the same columns: new and changed files under `root`."""
    spark.dataSource.register(FileTree)
    return spark.readStream.format("filetree").option("settle", settle).load(root)


def write_files(rows: DataFrame, root: str) -> int:
    """Write rows (path, content as text or bytes) as files under `root`; how many.

    Paths are relative. A repeated task writes its files again, each as a whole.
    """
    kind = rows.schema["content"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _system(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                full = f"{top.rstrip('/')}/{path}"
                folder = full.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(full) as stream:
                    stream.write((content or "").encode() if kind == "string" else content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    done = rows.select("path", "content").mapInArrow(run, "n long").groupBy().sum("n").first()[0]
    return done or 0
