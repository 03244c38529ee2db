"""Audit of how five document filters interact, in every order in which they can be applied.

A document's mask has a bit for each filter that it fails: A few words, B few distinct words, C many capitals, D special characters, E a text that
a document with a smaller id has too.  E needs the whole table: texts are routed by their XXH64 to the partitions of an RDD, where each hash has a chain of the full texts
that have it, each with its smallest id; whatever isn't the smallest is emitted as failing E.  Before the shuffle each task does the same
with its own rows in blocks of ``BLOCK_CHARS``, so of the copies of one text at most one for each block is sent with the text; the others are emitted at once and
only pass through, spread by their id.  Chains hold the distinct texts of a partition, so there are partitions for every ``CHAIN_CHARS`` characters of the table.

``combineByKey`` then merges, by part, vectors that count the documents of each of the 32 masks (all, good and toxic ones), within tasks first, so a
part with a third of all rows is no task's alone.  The 120 orders follow from a part's vector.

A null text is an empty one, a null part an empty string.  Rows without an id never fail E and have no labels.  Rows that share id and text are documents of
their own, with the same mask; a label counts where any row of that id has it.  Very long texts are read in pieces.  An empty table gives an empty
result.  Other columns are ignored, so extra columns never clash.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkit as K

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: Characters of texts that a task gathers before it sends on what it has, and those that a partition of chains should have at most.
BLOCK_CHARS, CHAIN_CHARS = 1 << 24, 1 << 25
_PIECE = 1 << 20
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_SPECIAL = re.compile(r"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def word_counts(text: str) -> tuple[int, int]:
    """(words, distinct words); long texts are split in pieces."""
    many, seen, at = 0, set(), 0
    while at < len(text):
        gap = _SPACE.search(text, at + _PIECE)
        to = gap.start() if gap else len(text)
        words = text[at:to].encode("utf-8", "surrogatepass").split()
        many += len(words)
        seen.update(words)
        at = to
    return many, len(seen)


def own_mask(text: str) -> int:
    """The filters A to D that a text fails, as bits."""
    many, distinct = word_counts(text)
    data = text.encode("utf-8", "surrogatepass")
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (many < 200) | (100 * distinct < 50 * many) << 1 | (100 * capitals > 2 * len(text)) << 2 | bool(_SPECIAL.search(text)) << 3


class _Chains:
    """Texts by hash, each with its smallest id so far, its mask and how many rows of each part have that id."""

    def __init__(self) -> None:
        self.by_hash: dict[int, list[list]] = {}
        self.chars = 0

    def add(self, key: int, text: str, doc: object, mask: int, parts: Counter) -> Iterator[tuple[object, str, int, int]]:
        """Rows (id, part, mask, how many) that a row with a smaller id makes fail E."""
        for entry in self.by_hash.setdefault(key, []):
            if entry[0] != text:
                continue
            if doc == entry[1]:
                entry[3].update(parts)
                return
            late = (doc, parts) if doc > entry[1] else (entry[1], entry[3])
            if doc < entry[1]:
                entry[1], entry[3] = doc, parts
            yield from ((late[0], part, mask | COPY, n) for part, n in late[1].items())
            return
        self.by_hash[key].append([text, doc, mask, parts])
        self.chars += len(text)

    def rest(self) -> Iterator[tuple[int, list]]:
        return ((key, entry) for key, chain in self.by_hash.items() for entry in chain)


def _passes(row: tuple) -> tuple[int, tuple]:
    """A finished row on its way through the shuffle, where its id says."""
    return zlib.crc32(repr(row[0]).encode()), (None, *row)


def _sent(rows: Iterable[tuple], key_of: Callable[[str], int]) -> Iterator[tuple[int, tuple]]:
    """(key, (text or none, id, part or parts, mask, how many)) of rows (part, id, text)."""
    chains = _Chains()
    for part, doc, text in rows:
        part, text = part or "", text or ""
        mask = own_mask(text)
        if doc is None:
            yield _passes((doc, part, mask, 1))
            continue
        for late in chains.add(key_of(text), text, doc, mask, Counter({part: 1})):
            yield _passes(late)
        if chains.chars > BLOCK_CHARS:
            yield from ((key, (entry[0], entry[1], entry[3], entry[2], 0)) for key, entry in chains.rest())
            chains = _Chains()
    yield from ((key, (entry[0], entry[1], entry[3], entry[2], 0)) for key, entry in chains.rest())


def _settled(pairs: Iterable[tuple[int, tuple]]) -> Iterator[tuple[object, str, int, int]]:
    """(id, part, mask, how many) with E decided."""
    chains = _Chains()
    for key, (text, doc, parts, mask, many) in pairs:
        if text is None:
            yield doc, parts, mask, many
        else:
            yield from chains.add(key, text, doc, mask, parts)
    yield from ((doc, part, mask, n) for _, (_, doc, mask, parts) in chains.rest() for part, n in parts.items())


def _text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def filter_masks(docs: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "source", key_of: Callable[[str], int] = _text_key) -> DataFrame:
    """(doc, part, mask, n): how many rows of that id and part fail just those filters."""
    spark = docs.sparkSession
    rows = docs.select(F.col(K._quoted(part)).cast("string"), F.col(K._quoted(doc)), F.col(K._quoted(text)))
    chars = docs.agg(F.sum(F.length(F.col(K._quoted(text))))).first()[0] or 0
    chains = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHAIN_CHARS))
    routed = rows.rdd.mapPartitions(lambda it: _sent(it, key_of)).partitionBy(chains, lambda key: key)
    kind = docs.schema[doc].dataType.simpleString()
    return spark.createDataFrame(routed.mapPartitions(_settled), f"doc {kind}, part string, mask int, n long", verifySchema=False)


def audit_rows(part: str, counts: list[int]) -> Iterator[tuple]:
    """The result's rows of a part, from the counts by mask of all, good and toxic documents."""
    n, good, toxic = counts[:32], counts[32:64], counts[64:]
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    failing = {f: sum(n[m] for m in range(32) if m & b) for f, b in bit.items()}
    # of the orders in which a document's failed filters come, each is the first equally often
    shapley = {f: sum(n[m] * (len(ORDERS) // m.bit_count()) for m in range(32) if m & b) for f, b in bit.items()}
    for order in ORDERS:
        before = 0
        for step, f in enumerate(order, 1):
            here = [m for m in range(32) if m & bit[f] and not m & before]
            removed = sum(n[m] for m in here)
            before |= bit[f]
            kept = sum(n[m] for m in range(32) if not m & before)
            yield part, order, step, kept, removed, failing[f] - removed, n[bit[f]], sum(good[m] for m in here), sum(toxic[m] for m in here), shapley[f]


def filter_audit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    labels: a row (doc, quality, toxic) for some documents.
    """
    spark = docs.sparkSession
    marked = labels.groupBy(F.col(K._quoted(doc)).alias("doc")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    with shared.Scratch(spark) as scratch:
        rows = scratch.table(filter_masks(docs, doc, text, part))
        named = rows.where("doc is not null").join(marked, "doc", "left").select("part", "mask", "n", "good", "toxic")
        unnamed = rows.where("doc is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))

        def added(counts: list[int], row: tuple) -> list[int]:
            mask, n, good, toxic = row
            counts[mask] += n
            counts[32 + mask] += n * bool(good)
            counts[64 + mask] += n * bool(toxic)
            return counts

        def merged(a: list[int], b: list[int]) -> list[int]:
            return [x + y for x, y in zip(a, b, strict=True)]

        by_part = named.unionByName(unnamed).rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: added([0] * 96, row), added, merged)
        schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
        return shared.table(spark.createDataFrame(by_part.flatMap(lambda x: audit_rows(*x)), schema, verifySchema=False))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
