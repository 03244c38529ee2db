"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased (in all scripts) runs of ASCII letters, digits and non-ASCII characters, so case and punctuation
don't matter.  A fixed mask picks some of the words of a window and ignores the others; hashes of the
picked words of benchmark and documents are joined.  Each hit fixes a diagonal, along which benchmark
item and document are compared word by word: the pair counts if some window of ``window`` words (or
the whole item, if it is shorter) around a hit differs in at most a quarter of its words, rounded down
(3 of 13).  The masks find every such pattern of up to three substitutions in 13 words, and further short masks those
in items or windows of 5 to 9 words.

The benchmark is the stated query set: it is sent to the executors in blocks of at most ``block_words``
words (a proven size), and each block passes over all documents, so there is no shuffle of documents and no limit
on the number of items; a benchmark of n blocks reads the documents n times.  One block is there at a time: where there are more, what a block's pass finds is
written to the shared folder and the block is destroyed before the next one is made.  Memory is bounded by the block (about 110 bytes a word),
a chunk of documents and the hits that are compared at once, however many items share a seed.

Null or empty texts match nothing.  Items with fewer than ``least_item_words`` words are too short to be
evidence and match nothing.  A document row that repeats is judged by itself; equal benchmark rows each
give their pairs.  Very long texts are read whole.  An empty table gives an empty result.  If both ids have one name, the item's
gets an underscore; other extra columns are never read (pairs) or kept as they are (filter).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from . import textkit as K

#: Word positions that each mask picks.  The last is for items shorter than the others' spans.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 8), (0, 1, 2, 6, 8), (0, 1, 2, 3, 4))
#: Further masks, for items or windows of fewer than SHORT words.
SHORT_MASKS, SHORT = ((0, 1, 2), (0, 1, 3)), 10
#: Hits, and words along diagonals, that are compared at once.
_HITS = 1 << 20
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _seed(h: np.ndarray, mask: tuple[int, ...], key: int) -> np.ndarray:
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, K.U64)
    c = K.keyed(len(mask), 100 + key) | K.U64(1)
    out = h[mask[0] : mask[0] + n] * c[0]
    for j in range(1, len(mask)):
        out += h[mask[j] : mask[j] + n] * c[j]
    return K.mix(out)


class Block:
    """Benchmark items with their seeds, as arrays."""

    def __init__(self, ids: list, texts: list[str | None], window: int, least: int):
        buf, off = K.utf8(pc.utf8_lower(pa.array(texts, pa.large_string())))
        w = K.find_words(buf, off, _GAP)
        self.ids, self.window = ids, window
        self.words = K.range_hashes(buf, w.start, w.end) if len(buf) else np.zeros(0, K.U64)
        self.first = w.first
        size = np.diff(w.first)
        self.seeds = []
        for k, mask in enumerate(MASKS + SHORT_MASKS):
            h = _seed(self.words, mask, k)
            at = np.arange(len(h))
            item = np.searchsorted(w.first, at, side="right") - 1
            fits = (at + mask[-1] < w.first[item + 1]) & (size[item] >= least)
            if k >= len(MASKS):
                fits &= np.minimum(size[item], window) < SHORT
            order = np.argsort(h[fits], kind="stable")
            h, at = h[fits][order], at[fits][order].astype(np.int32)
            bits = min(26, max(16, int(len(h) * 32).bit_length()))
            sieve = np.zeros(1 << bits, bool)
            sieve[(h >> K.U64(64 - bits)).astype(np.int64)] = True
            self.seeds.append((h, at, np.packbits(sieve, bitorder="little"), bits))

    def items(self, words: np.ndarray) -> np.ndarray:
        """The item of each of the words given by their places."""
        return np.searchsorted(self.first, words, side="right") - 1


def matches(buf: np.ndarray, off: np.ndarray, block: Block) -> dict[str, np.ndarray]:
    """The (document, item) pairs of a chunk that count, each with its best window."""
    w = K.find_words(buf, off, _GAP)
    none = {k: np.zeros(0, np.int64) for k in ("doc", "item", "window_matches", "item_matches", "start")}
    if not len(w.start) or not len(block.words):
        return none
    h = K.range_hashes(buf, w.start, w.end)
    best = np.zeros((6, 0), np.int64)
    for k, mask in enumerate(MASKS + SHORT_MASKS):
        keys, at, sieve, bits = block.seeds[k]
        if not len(keys):
            continue
        own = _seed(h, mask, k)
        bit = (own >> K.U64(64 - bits)).astype(np.int64)
        maybe = np.flatnonzero(sieve[bit >> 3] >> (bit & 7) & 1)
        lo = np.searchsorted(keys, own[maybe])
        many = np.searchsorted(keys, own[maybe], side="right") - lo
        maybe, lo, many = maybe[many > 0], lo[many > 0], many[many > 0]
        total = np.concatenate([[0], np.cumsum(many)])
        cut = 0
        while cut < len(many):  # a seed of many items and many places: so many hits at once
            to = max(cut + 1, int(np.searchsorted(total, total[cut] + _HITS, side="right")) - 1)
            each = many[cut:to]
            hit = np.repeat(lo[cut:to] - (total[cut:to] - total[cut]), each) + np.arange(total[to] - total[cut])
            place = np.repeat(maybe[cut:to], each)
            doc = np.searchsorted(w.first, place, side="right") - 1
            item = block.items(at[hit])
            begin = place - (at[hit] - block.first[item])  # the document's word where the item would begin
            found = _along(h, w.first, block, np.unique(np.stack([doc, item, begin]), axis=1))
            best = _best(np.concatenate([best, found], axis=1))
            cut = to
    doc, item, window_matches, item_matches, start, _ = best
    return {"doc": doc, "item": item, "window_matches": window_matches, "item_matches": item_matches, "start": start}


def _along(h: np.ndarray, first: np.ndarray, block: Block, diagonals: np.ndarray) -> np.ndarray:
    """(document, item, window_matches, item_matches, start, begin) of the diagonals (document, item, begin) that count."""
    doc, item, begin = diagonals
    size = (block.first[item + 1] - block.first[item]).astype(np.int64)
    out, total, at = [np.zeros((6, 0), np.int64)], np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(total, total[at] + _HITS, side="right")) - 1)
        d, i, b, n = doc[at:to], item[at:to], begin[at:to], size[at:to]
        base = total[at:to] - total[at]
        inner = np.arange(total[to] - total[at]) - np.repeat(base, n)
        where = np.repeat(b, n) + inner
        inside = (where >= np.repeat(first[d], n)) & (where < np.repeat(first[d + 1], n))
        same = inside & (h[np.clip(where, 0, len(h) - 1)] == block.words[np.repeat(block.first[i], n) + inner])
        sums = np.concatenate([[0], np.cumsum(same)])
        window = np.minimum(block.window, n)
        starts = n - window + 1
        edge = np.concatenate([[0], np.cumsum(starts)])
        offset = np.arange(edge[-1]) - np.repeat(edge[:-1], starts)
        from_ = np.repeat(base, starts) + offset
        runs = sums[from_ + np.repeat(window, starts)] - sums[from_]
        most = np.maximum.reduceat(runs, edge[:-1])
        lead = np.minimum.reduceat(np.where(runs == np.repeat(most, starts), offset, len(h) + len(block.words)), edge[:-1])
        good = most >= window - window // 4
        out.append(np.stack([d, i, most, sums[base + n] - sums[base], b + lead - first[d], b])[:, good])
        at = to
    return np.concatenate(out, axis=1)


def _best(found: np.ndarray) -> np.ndarray:
    """For each (document, item) the diagonal with the best window, then the most matches, then the first."""
    found = found[:, np.lexsort((found[5], -found[3], -found[2], found[1], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
    return found[:, new]


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, least: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; rows come to the driver one partition at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        words = len(row["t"] or "") // 2 + 1
        if ids and size + words > block_words:
            yield Block(ids, texts, window, least)
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += words
    yield Block(ids, texts, window, least)


def _one_by_one(blocks: Iterator[Block], passed: Callable[[Block], tuple[DataFrame, Broadcast]]) -> DataFrame:
    """The union of what each block's pass gives; of several blocks one is there at a time."""
    block, out = next(blocks), None
    while block is not None:
        part, sent = passed(block)
        block = next(blocks, None)
        if out is None and block is None:
            return part  # a single block
        part = shared.table(part)
        sent.destroy()
        out = part if out is None else out.unionAll(part)
    return out


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, least_item_words: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """One row for each contaminated pair: the two ids, the matching words of the best window and of the whole item, and the word of the document where that window begins."""
    schema = T.StructType([K.field(doc, docs.schema[doc].dataType), K.field(item if item != doc else f"{item}_", benchmark.schema[item].dataType)] + [K.field(n, T.LongType()) for n in ("item_words", "item_matches", "window_matches", "doc_word")])

    def passed(block: Block) -> tuple[DataFrame, Broadcast]:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            own = sent.value
            ids = pa.array(own.ids)
            for whole in batches:
                for b in K.slices(whole, "t"):
                    x = matches(*K.utf8(pc.utf8_lower(b.column(1))), own)
                    if len(x["doc"]):
                        sizes = np.diff(own.first)[x["item"]]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(x["doc"])), ids.take(pa.array(x["item"])), *(pa.array(v) for v in (sizes, x["item_matches"], x["window_matches"], x["start"]))], names=schema.names)

        return docs.select(F.col(f"`{doc}`").alias("d"), F.col(f"`{text}`").alias("t")).mapInArrow(K.frees(run), schema), sent

    return _one_by_one(_blocks(benchmark, item, item_text, window, least_item_words, block_words), passed)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, least_item_words: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark; same columns."""
    mark, row = shared.fresh(docs, "__clean"), shared.fresh(docs, "__row")
    blocks = _blocks(benchmark, item, item_text, window, least_item_words, block_words)

    def marked(rows: DataFrame, block: Block, keep: list[str]) -> tuple[DataFrame, Broadcast]:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def kernel(buf, off, batch):
            clean = np.ones(len(off) - 1, bool)
            folded = pc.utf8_lower(batch.column(batch.schema.get_field_index(text)))
            clean[matches(*K.utf8(folded), sent.value)["doc"]] = False
            return {mark: clean}

        return K.map_text(rows, text, [K.field(mark, T.BooleanType())], kernel, keep, with_batch=True), sent

    first = next(blocks)
    if (second := next(blocks, None)) is None:
        return marked(docs, first, docs.columns)[0].where(F.col(mark)).drop(mark)
    rows = shared.table(docs.withColumn(row, F.monotonically_increasing_id()))

    def passed(block: Block) -> tuple[DataFrame, Broadcast]:
        found, sent = marked(rows.select(row, K._quoted(text)), block, [row])
        return found.where(~F.col(mark)).select(row), sent

    gone = _one_by_one(chain((first, second), blocks), passed)
    return rows.join(gone.distinct(), row, "left_anti").select(*[K._quoted(c) for c in docs.columns])


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
