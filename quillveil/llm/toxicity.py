"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its lower-cased words, stripped of ASCII punctuation, of
pairs of neighbours and of pairs with one or two words between.  Training reads a bounded sample of the labelled rows
(at most ``sample_rows`` labels and ``sample_bytes`` of their texts, the documented bounds; in the order of a hash of the id, so the same at every
run), hashes it in parallel and fits the model in one task with per-coordinate rates; that task holds four numbers of 4 bytes for a word
at most.  L1 leaves few weights, at most one for each of 2**bits hash slots, which are broadcast.  Scoring is row by row, whole texts.

Null or empty texts have no features and get the score of the bias alone.  Rows without a usable label (null,
or neither 0 nor 1) are not learned from; of several labels of an id the largest counts.  Without any labelled row every score is 0.
Repeated documents are learned from once for each row and count towards the bounds.  An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Words from the first to the second of a pair.
STEPS = (1, 2, 3)


def features(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every feature of a chunk, repeats included."""
    w = K.find_words(buf, off, _GAP)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, doc, shift = K.range_hashes(buf, w.start, w.end), w.doc, K.U64(64 - bits)
    slots, docs = [h >> shift], [doc]
    for step in STEPS:
        if len(h) > step:
            ok = doc[step:] == doc[:-step]
            c = K.keyed(2, 200 + step) | K.U64(1)
            slots.append((K.mix(h[:-step] * c[0] + h[step:] * c[1]) >> shift)[ok])
            docs.append(doc[step:][ok])
    return np.concatenate(docs), np.concatenate(slots).astype(np.int64)


class Weights(NamedTuple):
    slot: np.ndarray
    weight: np.ndarray
    bias: float


def train(rows: list[tuple[np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> Weights:
    """FTRL-proximal over (distinct slots, label) rows, in their order."""
    z, n = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
    zb = nb = 0.0

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for slots, label in rows:
            zi, ni = z[slots], n[slots]
            wi = weight(zi, ni)
            wb = -zb / ((beta + nb**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(wi.sum() + wb, -35, 35))) - label
            gg = g * g
            z[slots] = zi + g - (np.sqrt(ni + gg) - np.sqrt(ni)) / alpha * wi
            n[slots] = ni + gg
            zb += g - ((nb + gg) ** 0.5 - nb**0.5) / alpha * wb
            nb += gg
    slot = np.flatnonzero(np.abs(z) > l1)
    return Weights(slot, weight(z[slot], n[slot]).astype(np.float64), float(-zb / ((beta + nb**0.5) / alpha + l2)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc: str = "doc_id", text: str = "text", label: str = "toxic", bits: int = 24, sample_rows: int = 20_000, sample_bytes: int = 1 << 27, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 3) -> Weights:
    """Weights learned from labelled rows for which learn (over the label table's id) holds: at most sample_rows labels, and texts of sample_bytes.

    Labels are taken in the order of their ids' hashes; a (very long) text that the room left cannot hold is left out, the ones after it are not.
    """
    key = F.col(f"`{doc}`")
    chosen = labels.where(F.col(label).isin(0, 1) & key.isNotNull() & learn).groupBy(key.alias("k")).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(sample_rows)
    texts = docs.select(key.alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "k")
    sizes = texts.groupBy("h", "k").agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).alias("bytes")).select("h", "bytes").toArrow().sort_by("h")  # sample_rows at most
    room, left_out = sample_bytes, []
    for h, size in zip(sizes["h"].to_pylist(), sizes["bytes"].to_pylist(), strict=True):  # a text that doesn't fit leaves room for later ones
        if size > room:
            left_out.append((h,))
        else:
            room -= size
    if left_out:
        texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(left_out, "h long")), "h", "left_anti")
    texts = texts.select("k", "t", "y")

    def hashed(batches):
        for whole in batches:
            for b in K.slices(whole, "t", K.LARGE_CHUNK):
                at, slots = features(*K.utf8(b.column(1)), bits)
                order = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[order], np.arange(b.num_rows + 1))
                rows = [np.unique(slots[order[x:y]]).astype(np.int32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["k", "y", "slots"])

    def learned(batches):
        rows: list[tuple] = []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
        rows = _shuffled(rows)
        w = train([(np.frombuffer(s, np.int32), y) for _, y, s in rows], bits, alpha, beta, l1, l2, epochs) if rows else Weights(np.zeros(0, np.int64), np.zeros(0), -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(w.slot, -1)), pa.array(np.append(w.weight, w.bias))], names=["slot", "weight"])

    sample = texts.mapInArrow(K.frees(hashed), T.StructType([K.field("k", docs.schema[doc].dataType), K.field("y", T.IntegerType()), K.field("slots", T.BinaryType())]))
    out = sample.repartition(1).mapInArrow(K.frees(learned), "slot long, weight double").toArrow()
    slot, weight = out.column(0).to_numpy(), out.column(1).to_numpy()
    return Weights(slot[slot >= 0], weight[slot >= 0], float(weight[slot < 0][0]) if (slot < 0).any() else -np.inf)


def _shuffled(rows: list[tuple]) -> list[tuple]:
    """The rows in an order that depends on them alone."""
    rows = sorted(rows, key=lambda r: (str(r[0]), r[2]))
    return [rows[i] for i in K.keyed(len(rows), 7).argsort()]


class Scorer:
    def __init__(self, w: Weights, bits: int):
        self.w, self.bits = w, bits
        self.known = np.zeros(1 << bits, bool)
        self.known[w.slot] = True

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, slot = features(buf, off, self.bits)
        hit = np.flatnonzero(self.known[slot])
        one = np.unique(doc[hit] << self.bits | slot[hit])
        total = np.bincount(one >> self.bits, self.w.weight[np.searchsorted(self.w.slot, one & (1 << self.bits) - 1)], minlength=len(off) - 1) + self.w.bias
        return np.where(np.isneginf(total), 0.0, 1 / (1 + np.exp(-np.clip(total, -700, 700))))


def score(docs: DataFrame, weights: Weights, text: str = "text", keep: list[str] | None = None, bits: int = 24, at: float = 0.3) -> DataFrame:
    """The kept columns (all, unless named), score and predicted; extra columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def kernel(buf: np.ndarray, off: np.ndarray, scorer: Scorer) -> dict[str, np.ndarray]:
        p = scorer(buf, off)
        return {"score": p, "predicted": (p >= at).astype(np.int32)}

    return K.map_text(docs, text, [K.field("score", T.DoubleType()), K.field("predicted", T.IntegerType())], kernel, docs.columns if keep is None else keep, before=lambda: Scorer(sent.value, bits))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    weights = fit(docs, labels, remainder != 2)
    return score(docs, weights, keep=["doc_id"]).select("doc_id", (remainder == 2).alias("held_out"), "score", "predicted")
