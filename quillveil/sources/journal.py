"""A journal as a data source of its own: tasks write events, and events appear when their batch is committed.

Below the journal's folder, ``data`` holds files of JSON lines that tasks wrote under names of their own, and ``commits`` holds one
file for each committed batch of each writer, which names the batch's files with their rows and bytes.  Only files that a commit names are read:

- A batch appears whole or not at all, and what a lost task or a failed batch left behind is never seen (``sweep`` removes it).
- A batch that is written again, because a stream was stopped between its commit and the note of it, is dropped: its first commit stands.
- On a local or mounted folder a task's file is on disk before the task ends, and a commit before its batch ends.

Folders are opened with pyarrow's file systems, so a path may be a URL that they know.  A writer's name belongs to one stream at a time.  Null
events and lines with line ends of their own are refused.  A journal only grows: overwriting is refused.  A journal without commits, or without a folder, is empty.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

FORMAT = "quillveil_journal"
SCHEMA = "writer string, batch long, line string"
#: Bytes after which a task begins a new file, and of files that a task reads.
FILE_BYTES = 128 << 20


def _opened(path: str):
    """(file system, folder) of a path or URL."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", path):  # as Hadoop writes local paths
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _is_local(system) -> bool:
    return system.type_name == "local"


def _put(system, path: str, parts: Iterator[bytes]) -> int:
    """Writes a file and makes it durable where that is ours to do; its bytes."""
    size = 0
    with system.open_output_stream(path) as out:
        for part in parts:
            size += out.write(part) or len(part)
    if _is_local(system):
        for name in (path, os.path.dirname(path)):
            f = os.open(name, os.O_RDONLY)
            try:
                os.fsync(f)
            finally:
                os.close(f)
    return size


def _names(system, folder: str) -> list:
    from pyarrow import fs

    return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))


@dataclass
class Written(WriterCommitMessage):
    #: (name, rows, bytes) of each file of a task.
    files: list[tuple[str, int, int]]


class _Writer:
    """What batches and streams have in common: tasks write files, the driver commits or aborts."""

    def __init__(self, path: str, writer: str, batch: int = 0):
        if not re.fullmatch(r"[A-Za-z0-9._-]{1,128}", writer):
            raise ValueError("a writer's name is made of letters, digits, dots, underscores and dashes")
        self.path, self.name, self.batch = path, writer, batch

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _opened(self.path)
        files, held, size, rows = [], [], 0, 0

        def flush() -> None:
            nonlocal held, size, rows
            if held:
                system.create_dir(f"{folder}/data", recursive=True)
                name = f"{uuid.uuid4().hex}.jsonl"
                files.append((name, rows, _put(system, f"{folder}/data/{name}", iter(held))))
            held, size, rows = [], 0, 0

        for b in batches:
            lines = b.column(0).to_pylist()
            if any(x is None or "\n" in x or "\r" in x for x in lines):
                raise ValueError("an event is one line")
            if lines:
                held.append("".join(f"{x}\n" for x in lines).encode())
                size, rows = size + len(held[-1]), rows + len(lines)
            if size >= FILE_BYTES:
                flush()
        flush()
        return Written(files)

    def _commit(self, messages: list[Written | None], batch: int) -> None:
        system, folder = _opened(self.path)
        at = f"{folder}/commits/{self.name}@{batch:019d}"
        if system.get_file_info(at).is_file:
            return self._abort(messages)
        system.create_dir(f"{folder}/commits", recursive=True)
        text = "".join(f"{name}\t{rows}\t{size}\n" for m in messages if m for name, rows, size in m.files)
        if _is_local(system):  # elsewhere a file appears when it is closed
            hidden = f"{folder}/commits/.{uuid.uuid4().hex}"
            _put(system, hidden, iter([text.encode()]))
            os.replace(hidden, at)
            f = os.open(f"{folder}/commits", os.O_RDONLY)
            os.fsync(f)
            os.close(f)
        else:
            _put(system, at, iter([text.encode()]))

    def _abort(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        for m in messages:
            for name, _, _ in m.files if m else ():
                if system.get_file_info(f"{folder}/data/{name}").is_file:
                    system.delete_file(f"{folder}/data/{name}")


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)


def commits(path: str) -> list[tuple[str, int, str, int, int]]:
    """(writer, batch, file, rows, bytes) of each committed file, and a row without a file for each commit of an empty batch."""
    system, folder = _opened(path)
    out = []
    for info in sorted(_names(system, f"{folder}/commits"), key=lambda i: i.base_name):
        writer, sign, batch = info.base_name.rpartition("@")
        if not sign:  # one that was not finished
            continue
        with system.open_input_stream(info.path) as f:
            lines = f.read().decode().splitlines()
        out += [(writer, int(batch), name, int(rows), int(size)) for name, rows, size in (x.split("\t") for x in lines)] or [(writer, int(batch), "", 0, 0)]
    return out


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """Committed files, so many bytes a task; names and sizes alone are planned with."""
        parts, held, size = [], [], 0
        for writer, batch, name, _, length in commits(self.path):
            if not name:
                continue
            if held and size + length > FILE_BYTES:
                parts.append(InputPartition(held))
                held, size = [], 0
            held.append((writer, batch, name))
            size += length
        return [*parts, InputPartition(held)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, folder = _opened(self.path)
        for writer, batch, name in partition.value:
            with system.open_input_stream(f"{folder}/data/{name}") as f:
                rest = b""
                while block := f.read(1 << 22):
                    *lines, rest = (rest + block).split(b"\n")
                    if lines:
                        n = len(lines)
                        yield pa.RecordBatch.from_arrays([pa.array([writer] * n), pa.array([batch] * n, pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())], names=["writer", "batch", "line"])


class Journal(DataSource):
    """Options: path; writer, the name that batches are numbered under; batch, the number of a batch that is not a stream's."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def _lines(self, schema: StructType, overwrite: bool) -> str:
        if overwrite:
            raise ValueError("a journal only grows")
        if [f.dataType.simpleString() for f in schema] != ["string"]:
            raise ValueError("events are written as one column of JSON lines")
        return self.options["path"]

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self._lines(schema, overwrite), self.options.get("writer", uuid.uuid4().hex), int(self.options.get("batch", 0)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self._lines(schema, False), self.options["writer"])


def _as_lines(events: DataFrame) -> DataFrame:
    events.sparkSession.dataSource.register(Journal)
    return events.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns])).alias("line"))


def append(events: DataFrame, path: str, writer: str | None = None, batch: int = 0) -> None:
    """Adds events.  With a writer's name, the batch of that number is added once, however often this is called."""
    out = _as_lines(events).write.format(FORMAT).mode("append")
    (out.options(writer=writer, batch=batch) if writer else out).save(path)


def append_stream(events: DataFrame, path: str, writer: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds a stream's events, each once: its batches are numbered under the writer's name."""
    out = _as_lines(events).writeStream.format(FORMAT).outputMode("append").options(path=path, writer=writer, checkpointLocation=checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed events, with the writer and the batch that each came with; an event that isn't of the schema has nulls."""
    spark.dataSource.register(Journal)
    lines = spark.read.format(FORMAT).load(path)
    return lines.select("writer", "batch", F.from_json("line", schema).alias("e")).select("e.*", F.col("writer").alias("journal_writer"), F.col("batch").alias("journal_batch"))


def sweep(path: str, older_seconds: float) -> int:
    """Removes files that no commit names and that are older than that, which must be longer than any batch takes; how many."""
    system, folder = _opened(path)
    before = time.time() - older_seconds  # files of later batches are not looked at
    named, gone = {name for _, _, name, _, _ in commits(path)}, 0
    for where in ("data", "commits"):
        for info in _names(system, f"{folder}/{where}"):
            left = info.base_name not in named if where == "data" else info.base_name.startswith(".")
            if left and info.mtime and info.mtime.timestamp() < before:
                system.delete_file(info.path)
                gone += 1
    return gone
