"""Language-model scoring by context-tree weighting.

The model predicts a text byte by byte and each byte bit by bit; a text ends with the byte 0xFF.  A node
is a context (the last 0 to 4 bytes; zeros before a text) with the bits of the next byte so far.  Its zeros and ones in the
training texts give a Krichevsky-Trofimov estimate; weighting mixes the estimates of all depths: a node
predicts with ``w * own estimate + (1 - w) * prediction of the longer context``, where w is the
posterior weight of its own estimate against its subtree's.

Counts cover all training bytes, and the tree keeps every byte n-gram that they hold, however rare.  It is built by key:
contexts are dealt out by their last two bytes, below which a subtree depends on no other; only depths 0 and 1
(at most 257 contexts) are collected.  A context never met adds an estimate without counts (1/2 for each bit), so the model
stays a proper distribution.  Each n-gram of the texts to score gets its probability where its subtree is; as many of the
most frequent as ``_MOST_SENT`` allows are broadcast, all others are looked up by a join.
Nothing is adapted while scoring: a text's score depends on it alone.

The baseline is a word unigram with add-half smoothing.  Words that make up at least a 2**-22 part of
the tokens are broadcast (so at most 2**22); all others are looked up by a join, none dropped.  Words are
counted by 64-bit hashes.

Null text: as if empty, so one end token and the terminator.  Repeated rows: each learned from and scored.  Very long texts are scored
whole.  Without training texts every bit has probability 1/2.  An empty table gives an empty result; extra columns stay, unless they have the
name of a result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from . import textkit as K

DEPTH = 4
END_BYTE = 0xFF
#: The key of the end token among word hashes.
END_WORD = int(K.keyed(1, 77).view(np.int64)[0])
WORD, GRAM = 0, 1
_MERGE_AT = 1_500_000
#: Scores of n-grams that may be broadcast (16 bytes each), and n-grams whose subtrees are built at once (whole subtrees).
_MOST_SENT, _AT_ONCE = 1 << 21, 1 << 17


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, text) for each byte of each text and its end: the byte in the low 8 bits, older bytes above."""
    docs, n = len(off) - 1, len(buf)
    size = np.diff(off)
    doc = np.repeat(np.arange(docs), size + DEPTH + 1)
    ext = np.zeros(n + docs * (DEPTH + 1), np.uint8)
    ext[np.arange(n) + DEPTH + (DEPTH + 1) * np.repeat(np.arange(docs), size)] = buf
    last = off[1:] + (DEPTH + 1) * np.arange(1, docs + 1) - 1
    ext[last] = END_BYTE
    wide = ext.astype(K.U64)
    g = wide.copy()
    for k in range(1, DEPTH + 1):
        g[k:] |= wide[:-k] << K.U64(8 * k)
    use = np.ones(len(ext), bool)
    use[((off[:-1] + (DEPTH + 1) * np.arange(docs))[:, None] + np.arange(DEPTH)).ravel()] = False
    return g[use], doc[use]


class _Tally:
    """Counts of 64-bit keys, merged now and then."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys = np.sort(keys)
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            keys, counts = keys[at], np.diff(np.append(at, len(keys)))
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > _MERGE_AT:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(self.keys or [np.zeros(0, K.U64)]), np.concatenate(self.counts or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts[order], at) if len(at) else counts
        self.keys, self.counts, self.held = [keys[at]], [counts], 0
        return self.keys[0], counts


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def count(docs: DataFrame, text: str, with_words: bool = True) -> DataFrame:
    """(kind, key, n) over all the texts: words and ends (unless they aren't wanted), and byte n-grams."""

    def tallied(batches):
        words, byte_grams, ends = _Tally(), _Tally(), 0
        for whole in batches:
            for b in K.slices(whole, "t", K.LARGE_CHUNK):
                buf, off = K.utf8(b.column(0))
                if with_words:
                    ends += b.num_rows
                    w = K.find_words(buf, off)
                    if len(w.start):
                        words.add(K.range_hashes(buf, w.start, w.end))
                byte_grams.add(grams(buf, off)[0])
        if ends:
            words.add(np.array([END_WORD], np.int64).view(K.U64), np.array([ends]))
        for kind, tally in ((WORD, words), (GRAM, byte_grams)):
            keys, counts = tally.merged()
            for at in range(0, len(keys), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int32)), _signed(keys[part]), pa.array(counts[part].astype(np.int64))], names=["kind", "key", "n"])

    return docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(K.frees(tallied), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0, by Stirling's series after a shift."""
    y = x + 8.0
    s = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for i in range(8):
        s -= np.log(x + i)
    return s


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level(NamedTuple):
    """The nodes of a depth in order of their key: context above, then 8 bits for the byte's bits so far after a leading one."""

    key: np.ndarray
    one: np.ndarray  # probability of a one by the node's own estimate
    own: np.ndarray  # weight of that estimate; 1 where no longer context is kept
    rest: np.ndarray  # probability of a one where the longer context isn't kept
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray  # ln of the weighted probability of the node's bits


def _level(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, kids: tuple[np.ndarray, ...] | None) -> Level:
    """kids: for each node the sums of its longer contexts' weighted, zeros and ones, and how many there are."""
    estimate, one = log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
    if kids is None:
        return Level(key, one, np.ones(len(key)), one, zeros, ones, estimate)
    split, a, b, many = kids
    a, b, has = np.maximum(zeros - a, 0), np.maximum(ones - b, 0), many > 0
    split = split + log_kt(a, b)
    weighted = np.where(has, np.logaddexp(estimate, split) - np.log(2), estimate)
    own = np.where(has, 1 / (1 + np.exp(np.clip(split - estimate, -700, 700))), 1.0)
    return Level(key, one, own, np.where(has, (b + 0.5) / (a + b + 1), one), zeros, ones, weighted)


def _shorter(key: np.ndarray, depth: int) -> np.ndarray:
    """The nodes at a depth that have these a byte deeper."""
    return (key >> K.U64(8) & K.U64((1 << 8 * depth) - 1)) << K.U64(8) | key & K.U64(0xFF)


def build(tables: list[tuple[np.ndarray, np.ndarray]], least: int = 0, bits: range = range(8)) -> list[Level]:
    """The weighted tree from (n-gram, count) for each depth from the least, n-grams as in grams() with so many context bytes.

    bits: only the nodes for these bits of a byte; those of different bits don't depend on each other.
    """
    levels: list[Level] = []
    for depth in range(least + len(tables) - 1, least - 1, -1):
        keys, n = tables[depth - least]
        context, byte = keys >> K.U64(8), (keys & K.U64(0xFF)).astype(np.int64)
        node = np.concatenate([context << K.U64(8) | ((1 << k) | (byte >> (8 - k))).astype(K.U64) for k in bits])
        bit = np.concatenate([byte >> (7 - k) & 1 for k in bits])
        many = np.tile(n.astype(np.float64), len(bits))
        key, at = np.unique(node, return_inverse=True)
        zeros, ones = np.bincount(at, many * (1 - bit), len(key)), np.bincount(at, many * bit, len(key))
        kids = None
        if levels and len(levels[-1].key):
            deep = levels[-1]
            at = np.searchsorted(key, _shorter(deep.key, depth))
            kids = tuple(np.bincount(at, x, len(key)) for x in (deep.weighted, deep.zeros, deep.ones, np.ones(len(deep.key))))
        levels.append(_level(key, zeros, ones, kids))
    return levels[::-1]


def log2_of_bytes(levels: list[Level], g: np.ndarray, bits: range = range(8)) -> np.ndarray:
    """log2 of the probability of (those bits of) each n-gram's byte after its context."""
    out = np.zeros(len(g))
    byte = (g & K.U64(0xFF)).astype(np.int64)
    context = g >> K.U64(8)
    for k in bits:
        prefix = ((1 << k) | (byte >> (8 - k))).astype(K.U64)
        found, place = [], []
        for depth, level in enumerate(levels):
            key = (context & K.U64((1 << 8 * depth) - 1)) << K.U64(8) | prefix
            at = np.minimum(np.searchsorted(level.key, key), max(len(level.key) - 1, 0))
            found.append(level.key[at] == key if len(level.key) else np.zeros(len(g), bool))
            place.append(at)
        p = np.full(len(g), 0.5)
        deeper = np.zeros(len(g), bool)  # the next longer context is kept
        for depth in range(len(levels) - 1, -1, -1):
            level, at, has = levels[depth], place[depth], found[depth]
            if len(level.key):
                below = np.where(deeper, p, level.rest[at])
                p = np.where(has, level.own[at] * level.one[at] + (1 - level.own[at]) * below, p)
            deeper = has
        out += np.log2(np.where(byte >> (7 - k) & 1, p, 1 - p))
    return out


def subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches in order of their first, in runs that end where it changes."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        c = [x.to_numpy() for x in batch.columns]
        held = c if held is None else [np.concatenate([h, x]) for h, x in zip(held, c, strict=True)]
        if len(held[0]) >= _AT_ONCE and len(last := np.flatnonzero(held[0] != held[0][-1])):
            cut = int(last[-1]) + 1
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _by_subtree(byte_grams: DataFrame) -> DataFrame:
    """Rows with the last two bytes of their context as the first column, dealt out and ordered by it."""
    rows = byte_grams.select(F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("part"), *byte_grams.columns)
    return rows.repartition("part").sortWithinPartitions("part", "key")


def _tables(g: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, count) for each depth below the collected ones."""
    out = []
    for depth in range(2, DEPTH + 1):
        keys, at = np.unique(g & K.U64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        out.append((keys, np.bincount(at, n, len(keys))))
    return out


def collected(byte_grams: DataFrame) -> list[Level]:
    """Depths 0 and 1 of the tree of all n-grams (key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n in subtrees(batches):
            tables = _tables(key.view(K.U64), n)
            for k in range(8):
                level = build(tables, 2, range(k, k + 1))[0]
                yield pa.RecordBatch.from_arrays([_signed(_shorter(level.key, 1)), _signed(level.key), *(pa.array(x) for x in (level.zeros, level.ones, level.weighted))], names=["up", "key", "zeros", "ones", "weighted"])

    nodes = _by_subtree(byte_grams).mapInArrow(K.frees(run), "up long, key long, zeros double, ones double, weighted double")
    children = F.sort_array(F.collect_list(F.struct("key", "weighted")))  # at most 256; summed in order, so that runs agree to the last bit
    got = nodes.groupBy("up").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.aggregate(children, F.lit(0.0), lambda s, x: s + x["weighted"]).alias("split")).toArrow()
    order = np.argsort(keys := got["up"].to_numpy().view(K.U64))
    zeros, ones, split = (got[c].to_numpy()[order] for c in ("zeros", "ones", "split"))
    one = _level(keys[order], zeros, ones, (split, zeros, ones, np.ones(len(keys))))
    key, at = np.unique(_shorter(one.key, 0), return_inverse=True)
    kids = tuple(np.bincount(at, x, len(key)) for x in (one.weighted, one.zeros, one.ones, np.ones(len(at))))
    return [_level(key, kids[1], kids[2], kids), one]


class Model(NamedTuple):
    levels: list[Level]  # depths 0 and 1
    grams: DataFrame | None  # (key, n) of every n-gram
    words: np.ndarray  # hashes of frequent words, in order
    word_counts: np.ndarray
    tokens: int
    distinct: int
    ends: int  # training texts, so the count of the end token


def fit(docs: DataFrame, learn: Column, text: str = "text", word_bits: int = 22) -> tuple[Model, DataFrame]:
    """The model from rows for which learn holds, and the table (key, n) of the words too rare to be in it."""
    counts = shared.table(count(docs.where(learn), text))
    total = counts.where(F.col("kind") == WORD).agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = int(total["n"] or 0), int(total["v"])
    words = counts.where((F.col("kind") == WORD) & (F.col("n") >= max(1, -(-tokens >> word_bits)))).select("key", "n").toArrow()
    hashes, order = (h := words["key"].to_numpy().view(K.U64)), np.argsort(h)
    byte_grams = counts.where(F.col("kind") == GRAM).select("key", "n")
    rare = counts.where((F.col("kind") == WORD) & (F.col("n") < max(1, -(-tokens >> word_bits)))).select("key", "n")
    ends = counts.where((F.col("kind") == WORD) & (F.col("key") == END_WORD)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Model(collected(byte_grams), byte_grams, hashes[order], words["n"].to_numpy()[order], tokens, distinct, int(ends)), rare


def valued(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(key, met, v) of every n-gram in docs: how often it occurs there and log2 of its byte's probability."""
    met = count(docs, text, with_words=False).select("key", F.lit(0).cast("long").alias("n"), F.col("n").alias("met"))
    rows = model.grams.select("key", "n", F.lit(0).cast("long").alias("met")).unionByName(met).groupBy("key").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))
    top = docs.sparkSession.sparkContext.broadcast(model.levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n, met in subtrees(batches):
            g = key.view(K.U64)
            tables, ask = _tables(g[n > 0], n[n > 0]), met > 0
            value = np.zeros(int(ask.sum()))
            for k in range(8):  # one bit at a time holds an eighth
                bits = range(k, k + 1)
                value += log2_of_bytes([*top.value, *build(tables, 2, bits)], g[ask], bits)
            yield pa.RecordBatch.from_arrays([pa.array(key[ask]), pa.array(met[ask]), pa.array(value)], names=["key", "met", "v"])

    return _by_subtree(rows).mapInArrow(K.frees(run), "key long, met long, v double")


def _least_sent(values: DataFrame, most: int) -> int:
    """The least power of two such that at most so many n-grams occur that often."""
    held, least = 0, 1
    for r in sorted(values.groupBy(F.length(F.bin("met")).alias("bits")).count().collect(), reverse=True):
        if (held := held + r["count"]) > most:
            least = 1 << r["bits"]
            break
    return least


def score(docs: DataFrame, model: Model, rare: DataFrame, text: str = "text", keep: list[str] | None = None, most_sent: int = _MOST_SENT) -> DataFrame:
    """The kept columns (all, unless named), n_tokens, n_known, base_score, score (log10) and bits_per_byte; extra columns of these names are replaced."""
    values = shared.table(valued(docs, model, text))
    least = _least_sent(values, most_sent)
    frequent = values.where(F.col("met") >= least).select("key", "v").toArrow()
    order = np.argsort(g := frequent["key"].to_numpy().view(K.U64))
    sent = docs.sparkSession.sparkContext.broadcast((model._replace(levels=[], grams=None), g[order], frequent["v"].to_numpy()[order]))
    keep = docs.columns if keep is None else keep
    names = ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")
    keep = [c for c in keep if c not in names]
    row, tail, left_grams, part = "__row", "__tail", "__grams", "__part"
    fields = [K.field("n_tokens", T.LongType()), K.field("n_known", T.LongType()), K.field("base_score", T.DoubleType()), K.field("score", T.DoubleType()), K.field("bits_per_byte", T.DoubleType()), *(K.field(c, T.ArrayType(T.LongType())) for c in (tail, left_grams))]

    def lists(keys: np.ndarray, doc: np.ndarray, texts: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts))]).astype(np.int32)), _signed(keys))

    def kernel(buf: np.ndarray, off: np.ndarray) -> dict[str, object]:
        (m, keys, known), texts = sent.value, len(off) - 1
        w = K.find_words(buf, off)
        h = K.range_hashes(buf, w.start, w.end) if len(w.start) else np.zeros(0, K.U64)
        doc = w.doc
        if len(m.words):
            at = np.minimum(np.searchsorted(m.words, h), len(m.words) - 1)
            frequent = m.words[at] == h
            value = np.where(frequent, np.log10(m.word_counts[at] + 0.5), 0.0)
        else:
            frequent, value = np.zeros(len(h), bool), np.zeros(len(h))
        n_tokens = np.diff(w.first) + 1
        base = np.bincount(doc, value, texts) + np.log10(m.ends + 0.5) - n_tokens * np.log10(m.tokens + 0.5 * (m.distinct + 1))
        g, at = grams(buf, off)
        packed = np.sort(g << K.U64(24) | at.astype(K.U64))
        g, at = packed >> K.U64(24), (packed & K.U64(0xFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        many = np.diff(np.append(new, len(g)))
        if len(keys):
            place = np.minimum(np.searchsorted(keys, g[new]), len(keys) - 1)
            there = keys[place] == g[new]
            found, there = np.repeat(np.where(there, known[place], 0.0), many), np.repeat(there, many)
        else:
            found, there = np.zeros(len(g)), np.zeros(len(g), bool)
        bits = np.bincount(at, found, texts)
        g, at = g[~there], at[~there]
        by_text = np.argsort(at, kind="stable")
        known_words = np.bincount(doc[frequent], minlength=texts) + (m.ends > 0)
        return {"n_tokens": n_tokens, "n_known": known_words, "base_score": base, "score": bits, "bits_per_byte": np.diff(off) + 1.0, tail: lists(h[~frequent], doc[~frequent], texts), left_grams: lists(g[by_text], at[by_text], texts)}

    rows = docs.withColumn(row, F.monotonically_increasing_id())
    scored = shared.table(K.map_text(rows, text, fields, kernel, [*keep, row], limit=K.LARGE_CHUNK))
    missing = scored.select(row, F.explode(tail).alias("key")).join(rare, "key", "left")
    more = missing.groupBy(row).agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias(part), F.count("n").alias("__known"))
    out = scored.drop(tail, left_grams).join(more, row, "left")
    bits = F.col("score")
    if least > 1:
        looked_up = scored.select(row, F.explode(left_grams).alias("key")).join(values.where(F.col("met") < least).select("key", "v"), "key")
        out = out.join(looked_up.groupBy(row).agg(F.sum("v").alias("__bits")), row, "left")
        bits = bits + F.coalesce("__bits", F.lit(0.0))
    return out.select(
        *[f"`{c}`" for c in keep],
        "n_tokens",
        (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce(part, F.lit(0.0))).alias("base_score"),
        (bits * float(np.log10(2))).alias("score"),
        (-bits / F.col("bits_per_byte")).alias("bits_per_byte"),
    )


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    model, rare = fit(docs, remainder != 1)
    return score(docs, model, rare, keep=["doc_id"]).select("doc_id", (remainder == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
