"""Array kernels over Arrow text batches that the operators of this subpackage share.

Texts stay UTF-8: a batch is one byte buffer plus document offsets.  A word is a maximal run of
bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+``.
Hashes depend on the text alone, never on the process, so they agree between executors and retries.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text bytes handled at once; bounds the arrays that a Python worker holds (a longer document is one chunk).  The large one is for kernels
#: that gather something for each chunk.
CHUNK_BYTES, LARGE_CHUNK = 1 << 20, 3 << 20

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def keyed(n: int, key: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers for a key."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key * 0xD1342543DE82EF95 & (1 << 64) - 1))


_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
LOWER = _LOWER.astype(np.uint8)
#: Masks of the lowest 0 to 8 bytes, and the step between the places of a range's 8-byte lanes.
_LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
_STEP, _SIZE = keyed(2, 2) | U64(1)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the len+1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


class Words(NamedTuple):
    """Byte ranges of the words of a chunk; the words of document d are first[d] to first[d + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> Words:
    """The maximal runs, within a document, of bytes for which the table gap is false."""
    n = len(buf)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64))
    inside = ~gap[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, off))


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte ranges: each 8-byte lane is mixed, mixed again with its place, and the lanes are added."""
    wide = np.zeros(len(buf) + 8, np.uint8)
    wide[: len(buf)] = LOWER[buf] if lower else buf
    at_byte = np.ndarray((len(buf) + 1,), "<u8", wide, 0, (1,))
    size = end - start
    lanes = (size + 7) >> 3
    first = np.concatenate([[0], np.cumsum(lanes)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], lanes)
    at = np.repeat(start, lanes) + 8 * place
    x = at_byte[at] & _LOWEST[np.minimum(np.repeat(end, lanes) - at, 8)]
    x = mix(mix(x) + place.astype(U64) * _STEP)
    return mix(sums(x, first) ^ (size.astype(U64) * _SIZE))


def window_hashes(h: np.ndarray, k: int, key: int) -> np.ndarray:
    """Hashes of k successive word hashes, one for each first word; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    c = keyed(k, key) | U64(1)
    out = h[:n] * c[0]
    for j in range(1, k):
        out += h[j : j + n] * c[j]
    return mix(out)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d + 1]] for every d, empty ranges included; unsigned sums wrap."""
    total = np.zeros(len(values) + 1, {"f": np.float64, "u": U64}.get(values.dtype.kind, np.int64))
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def code_points(buf: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte position; len(buf) + 1 numbers."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with at most limit bytes of text each, or one row if that has more."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to


def frees(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at the end of a task what it has freed goes back to the system: workers are used again by later stages, and idle ones stay."""

    @functools.wraps(run)
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


Kernel = Callable[[np.ndarray, np.ndarray], dict[str, object]]


def map_text(df: DataFrame, text: str, fields: list[T.StructField], kernel: Callable[..., dict], keep: list[str], with_batch: bool = False, before: Callable | None = None, limit: int = CHUNK_BYTES) -> DataFrame:
    """One row for each row of df: the kept columns and those that kernel(bytes, offsets) returns.

    A kept column with the name of a new one gives way to it.  with_batch: the kernel gets the Arrow
    batch as a third argument.  before: called in the worker once a task; its result is passed on.
    """
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    need = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = (before(),) if before else ()
        for whole in batches:
            for b in slices(whole, text, limit):
                out = kernel(*utf8(b.column(b.schema.get_field_index(text))), *((b,) if with_batch else ()), *extra)
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index(c)) for c in keep] + [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, ARROW[type(f.dataType)]) for f in fields],
                    names=schema.names,
                )

    return df.select(*[_quoted(c) for c in need]).mapInArrow(frees(run), schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary()}


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def strings(buf: np.ndarray, off: np.ndarray) -> list[str]:
    data = buf.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
