"""Bounded-space online packing of token documents into fixed windows.

Each partition keeps a fixed number of open windows.  A document's ids (closed with id 1) are cut into whole
windows as long as they fill one; what is left goes to the open window that it fits best.  When none has
room, the fullest is emitted as it is if at most ``tolerance`` ids are missing, otherwise it is filled up with the first
part of the piece, and the rest is placed anew.  At the end of the partition the open windows are merged: their pieces,
longest first, fill window after window, and the last one is cut at powers of two, which need no padding.

One pass, no shuffle; memory is bounded by the open windows and a chunk of documents.  A sequence never spans
partitions, so a recomputed partition is whole in itself.  Null or empty text: the closing id alone.
Repeated rows: packed each.  Very long texts are cut into as many windows as they fill.  An empty table gives no rows, and extra
columns are never read, so their names can't clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from . import tokens


class Piece(NamedTuple):
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int


class Packer:
    """add() and close() give finished windows, each a list of pieces."""

    def __init__(self, size: int = 2048, windows: int = 64, tolerance: int = 32):
        self.size, self.windows, self.tolerance = size, windows, tolerance
        self.open: dict[int, list[Piece]] = {}
        self.free: list[tuple[int, int]] = []  # (room, window), in order
        self.made = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        total, at = len(ids), 0
        while total - at >= self.size:
            yield [Piece(doc, at, ids[at : at + self.size], total)]
            at += self.size
        while at < total:
            left = total - at
            k = bisect_left(self.free, (left, -1))
            if k == len(self.free) and len(self.free) >= self.windows:
                room, window = self.free[0]
                if room > self.tolerance:  # fill the fullest
                    self.open[window].append(Piece(doc, at, ids[at : at + room], total))
                    at += room
                self.free.pop(0)
                yield self.open.pop(window)
                continue
            if k == len(self.free):
                self.open[self.made] = []
                insort(self.free, (self.size, self.made))
                self.made += 1
                k = len(self.free) - 1
            room, window = self.free.pop(k)
            self.open[window].append(Piece(doc, at, ids[at:], total))
            at = total
            if room == left:
                yield self.open.pop(window)
            else:
                insort(self.free, (room - left, window))

    def close(self) -> Iterator[list[Piece]]:
        """The open windows, merged."""
        pieces = sorted((p for w in self.open.values() for p in w), key=lambda p: -len(p.ids))
        self.open, self.free = {}, []
        window, used = [], 0
        for p in pieces:
            while used + len(p.ids) >= self.size:
                cut = self.size - used
                yield [*window, p._replace(ids=p.ids[:cut])]
                window, used = [], 0
                p = p._replace(start=p.start + cut, ids=p.ids[cut:])
            if len(p.ids):
                window.append(p)
                used += len(p.ids)
        while used:
            part = 1 << (used.bit_length() - 1)
            out, left, got = [], [], 0
            for p in window:
                n = min(len(p.ids), part - got)
                got += n
                if n:
                    out.append(p._replace(ids=p.ids[:n]))
                if n < len(p.ids):
                    left.append(p._replace(start=p.start + n, ids=p.ids[n:]))
            yield out
            window, used = left, used - part


def windows(batches: Iterator[pa.RecordBatch], size: int, open_windows: int, tolerance: int, vocabulary: str | None) -> Iterator[tuple[int, list[Piece]]]:
    """(sequence id, pieces) of each window packed from batches of (id, text)."""
    packer, number = Packer(size, open_windows, tolerance), TaskContext.get().partitionId() << 33
    for whole in batches:
        for b in K.slices(whole, "t"):
            ids, first = tokens.documents_ids(b.column(1), vocabulary)
            for doc, x, y in zip(b.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                for w in packer.add(doc, ids[x:y].copy() if y - x < size else ids[x:y]):
                    yield number, w
                    number += 1
    for w in packer.close():
        yield number, w
        number += 1


def pack(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 2048, open_windows: int = 64, tolerance: int = 32, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: doc, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    kind = docs.schema[doc].dataType
    schema = T.StructType([K.field(doc, kind), K.field("start", T.LongType()), K.field("length", T.LongType()), K.field("ids", T.BinaryType()), K.field("doc_tokens", T.LongType()), K.field("sequence_id", T.LongType()), K.field("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        arrow = None

        def batch() -> pa.RecordBatch:
            c = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c[0], arrow), *(pa.array(x, pa.binary() if i == 2 else pa.int64()) for i, x in enumerate(c[1:]))], names=schema.names)

        def noted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal arrow
            for b in source:
                arrow = b.column(0).type
                yield b

        for number, window in windows(noted(batches), size, open_windows, tolerance, vocabulary):
            at = 0
            for p in window:
                rows.append((p.doc, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.doc_tokens, number, at))
                at += len(p.ids)
            if len(rows) >= 500:
                yield batch()
        if rows:
            yield batch()

    return docs.select(F.col(f"`{doc}`").alias("d"), F.col(f"`{text}`").alias("t")).mapInArrow(K.frees(run), schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
