"""SimHash near-duplicates: an exact search of fingerprints at a small Hamming distance by vantage-point trees.

A text's fingerprint has a bit for each of the 64 that is set in over half of the XXH64 hashes of its 4-word shingles, repeats included.

Equal fingerprints are one point.  The 64 bits are cut into three masks: where two points differ in at most four bits, they differ in at most one bit
under one of the masks.  So there is a vantage-point tree for each mask, and in it pairs within distance 1 under the mask (and 4 in all)
have to be found.  A node has a vantage point and a radius: points within it go to the inner child, others to the outer one; both distances
obey the triangle inequality, so a point outside whose distance is within the bound of the radius also visits the inner child, and a visitor goes to a child
unless the bound rules out a partner there.  Each pair is met where the inner one of the two is at home.

The upper part of a tree is built on the driver from a sample of at most ``2 * SAMPLE`` points (16 bytes each), and its leaves are the shards:
points are routed to their own shard and to those that their bound reaches.  A shard goes on with nodes of its own until few pairs are left and
compares those.  Only a spanning forest of the links leaves it.  Shards of over ``block`` points (where the sample was off, or where no vantage
point separates the points) are dealt to pairs of blocks, so a task holds at most about twice as many.  The sample decides only where points
go: every point is indexed and searched, and results are exact.

Null or empty texts have the fingerprint zero and are linked like any other.  Repeated rows and exact copies are one point.  Rows without an id get a fingerprint
and the component's smallest id, null where no row of the component has one.  Very long texts are hashed in pieces.  An empty
table gives an empty result, and of the table's columns only the id and the text are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, shared
from . import textkit as K

WORDS, SEED, DISTANCE = 4, 42, 4
#: Three masks that share no bit, and the distance at which a tree of one finds pairs; the last is for nodes that the mask cannot separate.
MASKS = tuple(K.U64(((1 << n) - 1) << at) for at, n in ((0, 22), (22, 21), (43, 21)))
WHOLE = K.U64((1 << 64) - 1)
NEAR = DISTANCE // len(MASKS)
#: Points of the driver's sample (twice as many at most), points a shard should have, shards at most, shingles hashed at once.
SAMPLE, HOME, SHARDS, PIECE = 1 << 16, 1 << 13, 1 << 12, 1 << 16


def fingerprints(buf: np.ndarray, off: np.ndarray, k: int = WORDS) -> np.ndarray:
    """A 64-bit fingerprint of each text."""
    w = K.find_words(buf, off)
    size = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(np.where(size >= k, size - k + 1, np.minimum(size, 1)))])
    many = np.diff(first)
    owner = np.repeat(np.arange(len(size)), many)
    begin = np.arange(first[-1]) - first[owner] + w.first[owner]  # the first and the last word of each shingle
    last = np.minimum(begin + k, w.first[owner + 1]) - 1
    ones = np.zeros((len(size), 64), np.int64)
    for a in range(0, len(owner), PIECE):
        mine = owner[a : a + PIECE]
        bits = np.unpackbits(_shingle_hashes(buf, w, begin[a : a + PIECE], last[a : a + PIECE]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.flatnonzero(mine[1:] != mine[:-1]) + 1])
        ones[mine[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(K.U64)


def _shingle_hashes(buf: np.ndarray, w: K.Words, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XXH64 of the lower-cased words begin to last, joined by one space."""
    a, b = begin[0], last[-1] + 1
    start, end = w.start[a:b], w.end[a:b]
    text = K.LOWER[buf[start[0] : end[-1]]]
    start, end = start - start[0], end - start[0]
    keep = ~K.SPACE[text]
    gap = end[:-1][end[:-1] < start[1:]]  # a word may end its document and touch the next one's first
    text[gap] = 0x20
    keep[gap] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    start, end = place[start], place[end]
    view = memoryview(text[keep].tobytes())
    hashed = xxhash.xxh64_intdigest
    spans = zip(start[begin - a].tolist(), end[last - a].tolist(), strict=True)
    return np.fromiter((hashed(view[x:y], SEED) for x, y in spans), K.U64, len(begin))


def with_fingerprint(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """(doc, fp) of every row; fp holds the fingerprint's 64 bits as a long."""
    source = docs.select(F.col(K._quoted(doc)).alias("doc"), F.col(K._quoted(text)).alias("text"))
    return K.map_text(source, "text", [K.field("fp", T.LongType())], lambda buf, off: {"fp": fingerprints(buf, off, k).view(np.int64)}, ["doc"])


def _apart(points: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & mask).astype(np.int16)


class Tree(NamedTuple):
    """Nodes of a vantage-point tree; child numbers from len(vantage) on are leaves."""

    vantage: np.ndarray
    mask: np.ndarray
    bound: np.ndarray
    radius: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.vantage) + 1


def _choose(points: np.ndarray, mask: np.uint64, tries: int = 6) -> tuple[np.uint64, np.uint64, int, int] | None:
    """(vantage, mask, bound, radius) of the split after which fewest pairs remain; none if no split spares a tenth of them."""
    n, best, least = len(points), None, 0.9
    some = points[:: max(1, n // 2048)]
    for vantage in points[:: max(1, n // tries)][:tries]:
        for m, bound in ((mask, NEAR), (WHOLE, DISTANCE)):
            d = _apart(some, vantage, m)
            for radius in {int(np.median(d)), int(np.median(d)) - 1}:
                inside, visit = float((d <= radius).mean()), float(((d > radius) & (d <= radius + bound)).mean())
                if 0 < inside < 1 and (left := inside * (inside + 2 * visit) + (1 - inside) ** 2) < least:
                    best, least = (vantage, m, bound, radius), left
    return best


def build(sample: np.ndarray, mask: np.uint64, leaves: int) -> Tree:
    """A tree of at most so many leaves over a sample; the largest leaf is split next."""
    rows, parts, fixed = [], [(np.unique(sample), -1, 0)], []
    while parts and len(parts) + len(fixed) < leaves:
        at = max(range(len(parts)), key=lambda i: len(parts[i][0]))
        points, parent, side = parts.pop(at)
        split = _choose(points, mask) if len(points) > 1 else None
        if split is None:
            fixed.append((points, parent, side))
            continue
        d = _apart(points, split[0], split[1])
        rows.append([*split, 0, 0])
        parts += [(points[d <= split[3]], len(rows) - 1, 4), (points[d > split[3]], len(rows) - 1, 5)]
        if parent >= 0:
            rows[parent][side] = len(rows) - 1
    for leaf, (_, parent, side) in enumerate([*fixed, *parts]):
        if parent >= 0:
            rows[parent][side] = len(rows) + leaf
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return Tree(np.array(columns[0], K.U64), np.array(columns[1], K.U64), *(np.array(c, np.int64) for c in columns[2:]))


def route(tree: Tree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, index of the point, whether it is at home there) for every leaf that a point reaches."""
    out, todo = [], [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node >= len(tree.vantage):
            out.append((np.full(len(at), node - len(tree.vantage)), at, home))
            continue
        d = _apart(points[at], tree.vantage[node], tree.mask[node])
        bound, radius = tree.bound[node], tree.radius[node]
        inside = d <= radius
        inner, outer = inside | (d <= radius + bound), ~inside | (~home & (d > radius - bound))
        todo += [(int(tree.inner[node]), at[inner], (home & inside)[inner]), (int(tree.outer[node]), at[outer], (home & ~inside)[outer])]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): the smaller label is hooked on until all ends agree."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to != to[to]).any():
            to = to[to]
        label = to[label]
    return label


def linked_in_shard(points: np.ndarray, home: np.ndarray, mask: np.uint64, cells: int = 1 << 20) -> np.ndarray:
    """A label for each point of a shard: equal for those that links connect in which at least one is at home."""
    label = np.arange(len(points))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, visit = todo.pop()
        if not len(own) or len(own) + len(visit) < 2:
            continue
        split = _choose(points[own], mask) if len(own) * (len(own) + len(visit)) > cells else None
        if split is not None:
            vantage, m, bound, radius = split
            d, v = _apart(points[own], vantage, m), _apart(points[visit], vantage, m)
            inside = d <= radius
            todo.append((own[inside], np.concatenate([visit[v <= radius + bound], own[~inside & (d <= radius + bound)]])))
            todo.append((own[~inside], visit[v > radius - bound]))
            continue
        others = np.concatenate([own, visit])
        step = max(1, cells // len(others))
        for at in range(0, len(own), step):
            q = own[at : at + step]
            x, y = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[others][None, :]) <= DISTANCE)
            label = _joined(label, q[x], others[y])
    return label


def _routed(classes: DataFrame, trees: list[Tree]) -> DataFrame:
    """(tree, leaf, fp, home) for every shard that a point reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy().view(K.U64)
            for t, tree in enumerate(trees):
                leaf, at, home = route(tree, points)
                for lo in range(0, len(leaf), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf[part]), t, np.int32)), pa.array(leaf[part].astype(np.int32)), pa.array(points[at[part]].view(np.int64)), pa.array(home[part])], names=["tree", "leaf", "fp", "home"])

    return classes.select("fp").mapInArrow(K.frees(run), "tree int, leaf int, fp long, home boolean")


def _forest(dealt: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links of each (tree, leaf, i, j)."""

    def links(group: pa.Table) -> pa.Table:
        points, home = group.column("fp").combine_chunks().to_numpy().view(K.U64), group.column("home").combine_chunks().to_numpy(zero_copy_only=False)
        label = linked_in_shard(points, home, MASKS[group.column("tree")[0].as_py()])
        other = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": points[other].view(np.int64), "b": points[label[other]].view(np.int64)})

    return dealt.groupBy("tree", "leaf", "i", "j").applyInArrow(links, "a long, b long")


def fingerprint_links(classes: DataFrame, scratch: shared.Scratch, home: int = HOME, block: int = 1 << 16) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect just those that links of at most DISTANCE bits connect; classes: (fp)."""
    n = classes.count()
    share = (1 << 30) if n <= SAMPLE else (SAMPLE << 30) // n
    picked = classes.where(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(1 << 30)) < share).select("fp").limit(2 * SAMPLE).toPandas()["fp"]
    leaves = int(min(SHARDS, max(1, -(-n // home))))
    trees = [build(picked.to_numpy(np.int64).view(K.U64), mask, leaves) for mask in MASKS]
    routed = scratch.table(_routed(classes, trees))
    # a row for each shard, of which there is a fixed number at most
    parts = routed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = routed.join(F.broadcast(parts), ["tree", "leaf"]).withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    return _forest(own.withColumn("at", F.explode(pair)).select("tree", "leaf", "at.i", "at.j", "fp", "home"))


def simhash_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """(doc, fingerprint, component_id) of every row: component_id is the smallest id that links of at most DISTANCE bits connect it with."""
    with shared.Scratch(docs.sparkSession) as scratch:
        rows = scratch.table(with_fingerprint(docs, doc, text, k))
        classes = scratch.table(rows.groupBy("fp").agg(F.count("*").alias("many"), F.min("doc").alias("least")))
        nodes = graph.components(fingerprint_links(classes, scratch), scratch).withColumnRenamed("node", "fp")
        grouped = nodes.join(classes.select("fp", "least"), "fp")
        smallest = grouped.groupBy("component").agg(F.min("least").alias("smallest"))
        linked = nodes.join(smallest, "component").select("fp", "smallest", F.lit(True).alias("linked"))
        named = scratch.table(classes.join(linked, "fp", "left").select("fp", "many", F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("least")).alias("component_id")))
        # fewer than a thousand points can each have over a thousandth of the rows: those are broadcast, so that no task gets all copies of one
        most = rows.count() // 1000
        few = named.where(F.col("many") > most).select("fp", "component_id")
        hot = rows.join(F.broadcast(few), "fp")
        rest = rows.join(F.broadcast(few.select("fp")), "fp", "left_anti").join(named.where(F.col("many") <= most).select("fp", "component_id"), "fp")
        found = hot.unionByName(rest)
        return shared.table(found.select(F.col("doc").alias(doc), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
