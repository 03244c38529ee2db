"""A local or mounted folder as a data source: executors list it and read its files; nothing is listed by the driver.

Each task lists the upper levels of the folder's tree by names alone and takes the entries and the folders below them whose paths hash to it, so that
sizes, permissions and everything deeper are looked up by one task each.  Links are not followed, and neither they nor pipes, sockets and devices are
opened; they, and what can't be read, are rows like any other.  A path may have bytes that are no UTF-8: ``raw`` has them, ``path`` can be printed.
A folder that isn't there is one unreadable row; a root that is a file is that file.  What changes while it is read is given as it was met.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "quillveil_directory"
SCHEMA = "path string, raw binary, kind string, bytes long"
#: What an entry may be, and what a file's reading adds.
KINDS = ("file", "link", "special", "unreadable")
READ_KINDS = ("text", "not_utf8")
#: Bytes of files that a task reads, more or less.
TASK_BYTES = 64 << 20


def display_path(path: str) -> str:
    """A path that can be printed: bytes that are no UTF-8 become U+FFFD."""
    return path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _kind(path: bytes, status: os.stat_result) -> tuple[str, int | None]:
    if stat.S_ISREG(status.st_mode):
        return ("file", status.st_size) if os.access(path, os.R_OK) else ("unreadable", None)
    return "link" if stat.S_ISLNK(status.st_mode) else "special", None


def walk(root: bytes, levels: int, mine: Callable[[bytes], bool]) -> Iterator[tuple[bytes, str, int | None]]:
    """(path, kind, bytes) of the entries below root that are mine; a folder at that level is mine with all that it holds."""
    try:
        status = os.stat(root)
    except OSError:
        if mine(root):
            yield root, "unreadable", None
        return
    if not stat.S_ISDIR(status.st_mode):
        if mine(root):
            yield root, *_kind(root, status)
        return
    todo = [(root, 0)]
    while todo:
        folder, depth = todo.pop()
        own = depth >= levels
        try:
            with os.scandir(folder) as entries:
                for e in entries:
                    deeper = e.is_dir(follow_symlinks=False)
                    if not (own or mine(e.path) or (deeper and depth + 1 < levels)):
                        continue
                    if deeper:
                        todo.append((e.path, depth + 1))
                        continue
                    try:
                        found = _kind(e.path, e.stat(follow_symlinks=False))
                    except OSError:
                        found = "unreadable", None
                    yield e.path, *found
        except OSError:
            if own or mine(folder):
                yield folder, "unreadable", None


class Reader(DataSourceReader):
    def __init__(self, root: str, tasks: int, levels: int):
        self.root, self.tasks, self.levels = os.fsencode(root), max(tasks, 1), max(levels, 1)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held = []
        for row in walk(self.root, self.levels, lambda p: zlib.crc32(p) % self.tasks == partition.value):
            held.append(row)
            if len(held) == 8192:
                yield _batch(held)
                held = []
        yield _batch(held)


def _batch(rows: list[tuple[bytes, str, int | None]]) -> pa.RecordBatch:
    raw, kind, size = zip(*rows, strict=True) if rows else ((), (), ())
    shown = [display_path(os.fsdecode(p)) for p in raw]
    columns = [pa.array(shown, pa.string()), pa.array(raw, pa.binary()), pa.array(kind, pa.string()), pa.array(size, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "raw", "kind", "bytes"])


class Directory(DataSource):
    """Options: path; tasks that share the listing (8); levels of the tree that every task lists (2)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("tasks", 8)), int(self.options.get("levels", 2)))


def entries(spark: SparkSession, root: str, levels: int = 2) -> DataFrame:
    """(path, raw, kind, bytes) of what is below a folder, other than folders."""
    spark.dataSource.register(Directory)
    return spark.read.format(FORMAT).options(tasks=spark.sparkContext.defaultParallelism, levels=levels).load(root)


def contents(listed: DataFrame) -> DataFrame:
    """(path, kind, text) of listed entries: files become ``text``, or ``not_utf8`` or ``unreadable`` without a text.  Line ends stay as they are.

    Names are dealt to as many tasks as the files' bytes ask for; each file is read once by each job over the result.
    """
    total = listed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for path, raw, kind in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                text = None
                if kind == "file":
                    try:
                        with open(raw, "rb") as f:
                            data = f.read()
                        kind, text, size = "text", data.decode(), size + len(data)
                    except OSError:
                        kind = "unreadable"
                    except UnicodeDecodeError:
                        kind = "not_utf8"
                held.append((path, kind, text))
                if size >= 8 << 20:
                    yield _texts(held)
                    held, size = [], 0
            if held:
                yield _texts(held)

    return listed.select("path", "raw", "kind").repartition(tasks, "raw").mapInArrow(run, "path string, kind string, text string")


def _texts(rows: list[tuple[str, str, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "kind", "text"])
