"""Training-order materialisation into fixed-stride shards.

1. Documents are tokenized and packed into sequences in one pass; the sequences (compressed) are staged in the shared folder, with the
   task that made each and its place there.
2. Tasks' counts give every sequence a dense number from 0 to N - 1, and a keyed Feistel permutation with cycle-walking over exactly N
   members gives its global slot.
3. A shard holds ``shard_rows`` successive slots, and a range of whole shards goes to one task, which sorts it and writes its
   shards: records of fixed stride, a 4-byte length, then the ids, padded with zeros.  Slots follow from the permutation alone, so
   slot s is record ``s % shard_rows`` of shard ``s // shard_rows``: a reader resumes at any slot with one seek and reads on sequentially.

One shuffle of compressed ids; the number of ranges follows from N.  The payload goes straight from the shuffle to the shards; a retried task writes
under its own temporary name and renames it, so a lost executor leaves no half shard, and the staged table means that no text is
tokenized again.  The same key and the same partitions of the input give the same order.
Null or empty text: the closing id alone.  A null id: as any other document, with a null among the doc ids.  Repeated rows: each placed.
Very long texts go over as many sequences as they fill.  An empty table gives no shard and an empty index.  Extra columns are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packing, shared, tokens
from . import textkit as K

#: Bytes of records that a range should have at most, where there are more ranges than shuffle partitions.
RANGE_BYTES = 1 << 28
ROUNDS = 4


def feistel(x: np.ndarray, domain: int, key: int) -> np.ndarray:
    """A permutation of range(domain) that follows from the key, for an array of its members."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    low = K.U64((1 << half) - 1)
    keys = K.keyed(ROUNDS, key)
    out = np.array(x, K.U64)
    todo = np.arange(len(out))
    while len(todo):  # values outside the domain walk on along their cycle
        left, right = out[todo] >> K.U64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (K.mix(right + k) & low)
        out[todo] = left << K.U64(half) | right
        todo = todo[out[todo] >= K.U64(domain)]
    return out


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _dealers(spark: SparkSession, ranges: int) -> np.ndarray:
    """For each of so many partitions a number that hash partitioning sends there, so that every range has its own."""
    found, top = {}, 16 * ranges
    while len(found) < ranges:
        rows = spark.range(top).select(F.col("id").cast("int").alias("k")).groupBy(F.expr(f"pmod(hash(k), {ranges})").alias("p")).agg(F.min("k").alias("k")).collect()
        found, top = {r["p"]: r["k"] for r in rows}, 4 * top
    return np.array([found[p] for p in range(ranges)], np.int32)


def _staged(source: DataFrame, size: int, id_bytes: int, vocabulary: str | None) -> DataFrame:
    """(task, place, doc_ids, ids) of each sequence of (d, t) rows, its ids compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        if tokens.encoder(vocabulary).size > 1 << 8 * id_bytes:
            raise ValueError(f"ids of this vocabulary don't fit into {id_bytes} bytes")
        squeeze, task = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        held: list[list] = []
        at, id_type = 0, pa.int64()

        def batch() -> pa.RecordBatch:
            nonlocal at
            docs = [list(dict.fromkeys(p.doc for p in w)) for w in held]
            ids = [squeeze.compress(np.concatenate([p.ids for p in w]).astype(f"<u{id_bytes}").tobytes()) for w in held]
            n, at = len(held), at + len(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int32()), pa.array(range(at - n, at), pa.int64()), pa.array(docs, pa.list_(id_type)), pa.array(ids, pa.binary())], names=["task", "place", "doc_ids", "ids"])

        def noted(source_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in source_:
                id_type = b.column(0).type
                yield b

        for _, window in packing.windows(noted(batches), size, 64, 32, vocabulary):
            held.append(window)
            if len(held) >= 512:
                yield batch()
        if held:
            yield batch()

    return source.mapInArrow(K.frees(run), f"task int, place long, doc_ids array<{source.schema['d'].dataType.simpleString()}>, ids binary")


def materialise(docs: DataFrame, folder: str, key: int = 20240229, doc: str = "doc_id", text: str = "text", size: int = 2048, shard_rows: int = 4096, ranges: int | None = None, id_bytes: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Writes the shards below folder and returns their index: (slot, shard, row, n_tokens, sequence_id, doc_ids) of each sequence.

    folder: a URI that executors and driver share.  id_bytes: 2 or 4; a vocabulary with larger ids is refused.  ranges: at most so many tasks write.
    """
    spark = docs.sparkSession
    stride, id_kind = 4 + size * id_bytes, docs.schema[doc].dataType.simpleString()
    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    with shared.Scratch(spark) as scratch:
        staged = scratch.table(_staged(docs.select(F.col(f"`{doc}`").alias("d"), F.col(f"`{text}`").alias("t")), size, id_bytes, vocabulary))
        counts = sorted(tuple(r) for r in staged.groupBy("task").agg(F.count("*")).collect())  # one number for each task
        total = sum(n for _, n in counts)
        task_ids, before = np.array([t for t, _ in counts], np.int64), np.cumsum([0, *(n for _, n in counts)])
        shards = -(-total // shard_rows)
        ranges = max(1, min(shards, ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * stride // RANGE_BYTES))))
        range_rows = shard_rows * max(1, -(-shards // ranges))
        dealers = _dealers(spark, ranges)

        def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                number = before[np.searchsorted(task_ids, b.column(0).to_numpy())] + b.column(1).to_numpy()
                slot = feistel(number.astype(K.U64), total, key).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(dealers[slot // range_rows]), pa.array(slot), pa.array(number), b.column(2), b.column(3)], names=["dealer", "slot", "sequence_id", "doc_ids", "ids"])

        placed = staged.mapInArrow(K.frees(slotted), f"dealer int, slot long, sequence_id long, doc_ids array<{id_kind}>, ids binary")
        ordered = placed.repartition(ranges, "dealer").sortWithinPartitions("slot").drop("dealer")

        def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            fs, root = _filesystem(folder)
            expand = zstandard.ZstdDecompressor()
            out, shard, temporary = None, -1, ""

            def finish() -> None:
                nonlocal out
                if out is not None:
                    out.close()
                    fs.move(f"{root}/{temporary}", f"{root}/{shard_name(shard)}")
                    out = None

            for b in batches:
                slots, lengths = b.column(0).to_numpy(), []
                for slot, squeezed in zip(slots.tolist(), b.column(3), strict=True):
                    if slot // shard_rows != shard:
                        finish()
                        shard = slot // shard_rows
                        temporary = f".{shard_name(shard)}.{uuid.uuid4().hex}"
                        out = fs.open_output_stream(f"{root}/{temporary}")
                    if out.tell() != slot % shard_rows * stride:
                        raise ValueError("a slot is missing or taken twice")
                    ids = expand.decompress(squeezed.as_buffer())
                    out.write((len(ids) // id_bytes).to_bytes(4, "little") + ids.ljust(stride - 4, b"\0"))
                    lengths.append(len(ids) // id_bytes)
                names = [shard_name(s) for s in (slots // shard_rows).tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(slots % shard_rows), pa.array(lengths, pa.int64()), b.column(1), b.column(2)], names=["slot", "shard", "row", "n_tokens", "sequence_id", "doc_ids"])
            finish()

        return shared.table(ordered.mapInArrow(K.frees(written), f"slot long, shard string, row long, n_tokens long, sequence_id long, doc_ids array<{id_kind}>"))


def shard_name(shard: int) -> str:
    return f"shard-{shard:09d}.bin"


def manifest(index: DataFrame) -> DataFrame:
    """(shard, first_slot, rows) in slot order."""
    return index.groupBy("shard").agg(F.min("slot").alias("first_slot"), F.count("*").alias("rows")).orderBy("first_slot")


def read_from(folder: str, slot: int = 0, size: int = 2048, shard_rows: int = 4096, id_bytes: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from a slot on, in order, by one seek and then sequential reads."""
    fs, root = _filesystem(folder)
    stride = 4 + size * id_bytes
    while (info := fs.get_file_info(f"{root}/{shard_name(slot // shard_rows)}")).is_file:
        with fs.open_input_file(info.path) as f:
            f.seek(slot % shard_rows * stride)
            for slot in range(slot, slot - slot % shard_rows + info.size // stride):
                record = f.read(stride)
                yield slot, np.frombuffer(record, f"<u{id_bytes}", int.from_bytes(record[:4], "little"), 4)
        if info.size < shard_rows * stride:
            return
        slot += 1


def read_back(index: DataFrame, folder: str, size: int = 2048, id_bytes: int = 2) -> DataFrame:
    """The index with the length and ids_crc32 of each record as the shards have it; a shard is read by one task, in order."""
    stride = 4 + size * id_bytes
    schema = T.StructType([*index.schema.fields, T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        name, f = None, None
        for b in batches:
            lengths, digests = [], []
            for shard, row in zip(b.column("shard").to_pylist(), b.column("row").to_pylist(), strict=True):
                if shard != name:
                    if f is not None:
                        f.close()
                    name, f = shard, fs.open_input_file(f"{root}/{shard}")
                if f.tell() != row * stride:
                    f.seek(row * stride)
                record = f.read(stride)
                n = int.from_bytes(record[:4], "little")
                lengths.append(n)
                digests.append(zlib.crc32(np.frombuffer(record, f"<u{id_bytes}", n, 4).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths, pa.int64()), pa.array(digests, pa.int64())], names=schema.names)
        if f is not None:
            f.close()

    return index.repartition("shard").sortWithinPartitions("shard", "row").mapInArrow(K.frees(run), schema)


def op3_training_order(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared.folder(spark)}/quillveil-shards-{uuid.uuid4().hex}"
    index = materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_back(index, folder).select("slot", "shard", "row", "n_tokens", "ids_crc32", "sequence_id", "doc_ids")
