"""MinHash-style near-duplicate detection with SetSketch registers.

A document's set is its distinct 5-word shingles (as 64-bit hashes).  Its SetSketch has 256 registers:
each shingle yields ascending, exponentially spaced values for the registers in a random order, and
stops as soon as a value can no longer lower any register's minimum; a register keeps
``floor(1 - log_b(minimum))`` truncated to 16 bits.  Sketches merge by register-wise maximum.

1. Texts with equal sets form a class; everything below sees one representative of a class.
2. 32 bands of four registers, the first 128: classes with an equal band share a bucket.  A pair of similarity 0.75 shares none
   with probability below 6e-6.
3. In a bucket the similarity of a pair is estimated jointly by likelihood from the registers (greater, smaller, equal) and
   the set sizes; a pair is given up only if 0.75 contradicts them by five standard deviations (3e-7 of those at 0.75).  Pairs that are
   not given up connect classes to clusters.  Only a spanning forest of each bucket leaves it: a class that the forest has
   already joined to the largest tree isn't compared again, so a bucket of n classes gives n - 1 rows at most.
4. The texts of each cluster are brought together once, and links are decided on the full sets.  Again a class is compared with all
   others only until it belongs to the largest component, and a spanning forest of the links is all that leaves.
5. The label of a component is its smallest doc_id.

Buckets of over ``block`` classes and clusters of over ``block_shingles`` shingles are split: a lead is compared with every member,
which takes one pass; the members that it joins (the core) are dealt out once for each block of the others, and the others once for each block
of the core and of themselves.  Two members of the core need no comparison, as they are joined.  The work that remains is others times members;
it is spread over tasks of bounded size.  Intermediate tables go to the shared folder and are removed, but for a
small one with the result's labels.

Null or empty texts: empty set, linked with nothing.  A null id: linked with nothing, component null,
kept.  Repeated rows are one document and get the same result; rows that share an id but not a text are
compared as separate documents with that id.  Very long texts are sets like any other.  An empty table gives an
empty result, and of the table's columns only the id and the text are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, shared
from . import textkit as K

WORDS = 5
REGISTERS, ROWS, BANDS = 256, 4, 32
BASE, RATE = 1.001, 20.0
#: Rows of ids that a broadcast may hold; beyond, the same join is shuffled.
BROADCAST_IDS = 250_000


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, in order, and where each text's begin."""
    w = K.find_words(buf, off)
    docs = len(off) - 1
    if not len(w.start):
        return np.zeros(0, K.U64), np.zeros(docs + 1, np.int64)
    h = K.range_hashes(buf, w.start, w.end)
    size = np.diff(w.first)
    long = size >= k
    at = np.arange(len(h))
    inside = long[w.doc] & (at + k <= w.first[1:][w.doc])
    values = np.zeros(len(h), K.U64)
    windows = K.window_hashes(h, k, 3)
    values[: len(windows)] = windows
    for d in np.flatnonzero((size > 0) & ~long):  # the whole sequence as one
        a, b = w.first[d], w.first[d + 1]
        values[a] = K.window_hashes(h[a:b], b - a, 30 + int(b - a))[0]
        inside[a] = True
    values = values[inside]
    first = np.concatenate([[0], np.cumsum(np.bincount(w.doc[inside], minlength=docs))])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][first[:-1] < len(values)]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return values[new], total[first]


def set_sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers (sets x 256, 16 bits) of sets of 64-bit hashes; zeros for an empty set."""
    docs, m = len(first) - 1, REGISTERS
    least = np.full(docs * m, np.inf)
    doc = np.repeat(np.arange(docs), np.diff(first))
    seed = K.mix(values ^ K.U64(0x5851F42D4C957F2D))
    begin, step = (seed & K.U64(m - 1)).astype(np.int64), (seed >> K.U64(20)).astype(np.int64) & (m - 1) | 1
    x = np.zeros(len(values))
    for j in range(m):
        if not len(x):
            break
        u = (K.mix(seed + K.U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> K.U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        x -= np.log(u) / (RATE * (m - j))
        np.minimum.at(least, doc * m + ((begin + j * step) & (m - 1)), x)
        top = least.reshape(docs, m).max(axis=1)
        alive = x < top[doc]
        if not alive.all():
            x, doc, seed, begin, step = x[alive], doc[alive], seed[alive], begin[alive], step[alive]
    out = np.zeros(docs * m, np.uint16)
    set_ = np.isfinite(least)
    out[set_] = np.clip(np.floor(1 - np.log(least[set_]) / np.log(BASE)), 0, 65535).astype(np.uint16)
    return out.reshape(docs, m)


def plausible(greater: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(joint likelihood estimate of the Jaccard similarity, whether ``similarity`` or more is within five standard deviations).

    greater, smaller: how many of a's registers are above and below b's.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = REGISTERS - greater - smaller
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return greater * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    # for a base near 1 the likelihood is concave, and its maximum is the smaller root of a quadratic
    half = (equal * (u * u + v * v) + v * v * greater + u * u * smaller) / 2
    root = half - np.sqrt(np.maximum(half * half - u * u * v * v * REGISTERS * equal, 0))
    estimate = np.clip(root / (u * v * REGISTERS), 0, most)
    near = (estimate >= similarity) | (log_likelihood(np.minimum(similarity, most)) >= log_likelihood(estimate) - 12.5)
    return estimate, near & (most >= similarity - 1e-9)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def sketch(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """(doc, t64, n_shingles, h1, h2, registers) of every row; h1 and h2 tell sets apart, t64 texts of one id."""

    def kernel(buf: np.ndarray, off: np.ndarray) -> dict[str, object]:
        values, first = shingle_sets(buf, off, k)
        regs = set_sketches(values, first)
        return {"n_shingles": np.diff(first), "h1": _sum(values, first, 11), "h2": _sum(values, first, 12), "registers": pa.array([r.tobytes() for r in regs], pa.binary())}

    fields = [K.field("n_shingles", T.LongType()), K.field("h1", T.LongType()), K.field("h2", T.LongType()), K.field("registers", T.BinaryType())]
    source = docs.select(F.col(f"`{doc}`").alias("__doc"), F.col(f"`{text}`").alias("__text"), F.xxhash64(F.col(f"`{text}`")).alias("t64"))
    return K.map_text(source, "__text", fields, kernel, ["__doc", "t64"])


def _sum(values: np.ndarray, first: np.ndarray, key: int) -> np.ndarray:
    return K.sums(K.mix(values ^ K.keyed(1, key)[0]), first).view(np.int64)


def _bands(classes: DataFrame) -> DataFrame:
    """(key, rid) for every band of every class; the bands are made of the first registers."""
    salt = K.keyed(BANDS, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                keys = K.mix(_registers(b.column(1)).view(K.U64)[:, :BANDS] + salt).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["key", "rid"])

    return classes.select("rid", "registers").mapInArrow(K.frees(run), "key long, rid long")


def _with_text(docs: DataFrame, wanted: DataFrame, doc: str, text: str) -> DataFrame:
    """The rows of wanted (with rep and t64, the id and the hash of a text), each with that text as t; repeated documents repeat them."""
    source = docs.select(F.col(f"`{doc}`").alias("rep"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("t64"))
    few = wanted.count() <= BROADCAST_IDS
    return source.join(F.broadcast(wanted) if few else wanted, ["rep", "t64"])


def _once_a_task(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows without those whose (long) key columns an earlier row of the same task has, so that repeated documents don't meet in one task."""
    schema = rows.schema
    place = [schema.names.index(c) for c in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            fresh = []
            for x in zip(*(b.column(i).to_pylist() for i in place), strict=True):
                fresh.append(x not in seen)
                seen.add(x)
            yield b if all(fresh) else b.filter(pa.array(fresh, pa.bool_()))

    return rows.mapInArrow(K.frees(run), schema)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float, k: int = WORDS, run_length: int = 1024) -> DataFrame:
    """(a, b, linked) of every pair, decided on full sets.

    The text of a goes once to each run of at most about run_length of its pairs; partners stream past it.
    """
    share = round(similarity * 100)
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / run_length).alias("runs"))
    dealt = pairs.join(runs, "a").select("a", "b", F.pmod(F.xxhash64("b"), "runs").alias("run"))
    partner = dealt.join(texts.withColumnRenamed("rid", "b"), "b").select("a", "run", "b", "t")
    lead = dealt.select("a", "run").distinct().join(texts.withColumnRenamed("rid", "a"), "a").select("a", "run", F.lit(None).cast("long").alias("b"), "t")
    rows = partner.unionByName(lead).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = None, np.zeros(0, K.U64)
        for whole in batches:
            for batch in K.slices(whole, "t"):
                values, first = shingle_sets(*K.utf8(batch.column(3)), k)
                a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                out_a, out_b, linked = [], [], []
                for i, (x, y) in enumerate(zip(a, b, strict=True)):
                    this = values[first[i] : first[i + 1]]
                    if y is None:
                        own, base = x, this.copy()
                        continue
                    if own != x:
                        raise ValueError("a pair without its first text")
                    at = np.minimum(np.searchsorted(base, this), len(base) - 1)
                    common = int((base[at] == this).sum())
                    out_a.append(x)
                    out_b.append(y)
                    linked.append(100 * common >= share * (len(base) + len(this) - common))
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows.mapInArrow(K.frees(run), "a long, b long, linked boolean")


def _least_equal(similarity: float) -> float:
    """Equal registers that a pair of this similarity has, less six standard deviations."""
    return REGISTERS * similarity - 6 * (REGISTERS * similarity * (1 - similarity)) ** 0.5


def _dealt(rows: DataFrame, group: str, weight: str, block: int) -> DataFrame:
    """Rows (group, rid, core, weight) of groups to be split, with the pair (i, j) of blocks whose task they go to.

    Block i of the core meets block j of the others, and the others' blocks meet each other.  A core without others needs no task.
    """
    size = F.sum(F.when(F.col("core"), F.col(weight)).otherwise(0)), F.sum(F.when(F.col("core"), 0).otherwise(F.col(weight)))
    blocks = [F.greatest(F.ceil(x / block), F.lit(1)).cast("int").alias(name) for x, name in zip(size, ("cores", "others"), strict=True)]
    left = F.count_if(~F.col("core")).alias("left")
    both = rows.join(rows.groupBy(group).agg(*blocks, left).where("left > 0"), group)
    own = F.pmod(F.xxhash64("rid"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("others"))).cast("int")
    both = both.withColumn("own", own)
    in_core = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.col("own").alias("i"), j.cast("int").alias("j")))
    to_core = F.transform(F.sequence(F.lit(0), F.col("cores") - 1), lambda i: F.struct(i.cast("int").alias("i"), F.col("own").alias("j")))
    pair = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct((F.col("cores") + F.least("own", j)).cast("int").alias("i"), F.greatest("own", j).cast("int").alias("j")))
    places = F.when(F.col("core"), in_core).otherwise(F.concat(to_core, pair))
    return both.withColumn("at", F.explode(places)).select(*rows.columns, "at.i", "at.j")


class _Forest:
    """Members of a group and what joins them; those flagged as core are joined from the start."""

    def __init__(self, core: np.ndarray):
        self.label = np.arange(len(core))
        if core.any():
            self.label[core] = np.flatnonzero(core)[0]
        self.todo = np.ones(len(core), bool)

    def open(self) -> np.ndarray:
        """Members still to be compared: links between members of the largest component don't matter."""
        largest = np.bincount(self.label).argmax()
        return np.flatnonzero(self.todo & (self.label != largest))

    def join(self, member: int, linked: np.ndarray) -> np.ndarray:
        """Joins a member with those that it is linked with; one of these for each component that this merged."""
        labels, at = np.unique(self.label[linked], return_index=True)
        at = at[labels != self.label[member]]
        if len(at):
            to = np.arange(len(self.label))
            to[self.label[linked[at]]] = self.label[member]
            self.label = to[self.label]
        return linked[at]


def _plausible_forest(core: np.ndarray, n: np.ndarray, regs: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a bucket that similarity doesn't contradict."""
    least, forest, out = _least_equal(similarity), _Forest(core), []
    while len(rest := forest.open()):
        i = rest[0]
        forest.todo[i] = False
        other = np.flatnonzero(forest.todo & (forest.label != forest.label[i]) & (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i])))
        for at in range(0, len(other), 4096):
            j = other[at : at + 4096]
            x = regs[j]
            j, x = (j[maybe], x[maybe]) if not (maybe := (x == regs[i]).sum(1) >= least).all() else (j, x)
            if len(j):
                _, fits = plausible((regs[i] > x).sum(1), (regs[i] < x).sum(1), np.full(len(j), n[i], float), n[j].astype(float), similarity)
                out += [(i, int(k)) for k in forest.join(i, j[fits])]
    return out


def _plausible_pairs(p: np.ndarray, q: np.ndarray, n: np.ndarray, regs: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows similarity doesn't contradict."""
    ok = np.minimum(n[p], n[q]) >= similarity * np.maximum(n[p], n[q])
    for at in range(0, len(p), 4096):  # registers of so many pairs at once
        part = at + np.flatnonzero(ok[at : at + 4096])
        x, y = regs[p[part]], regs[q[part]]
        maybe = (x == y).sum(1) >= _least_equal(similarity)
        ok[part[~maybe]] = False
        part, x, y = part[maybe], x[maybe], y[maybe]
        if len(part):
            ok[part] = plausible((x > y).sum(1), (x < y).sum(1), n[p[part]].astype(float), n[q[part]].astype(float), similarity)[1]
    return ok


def _bucket_edges(members: DataFrame, similarity: float, small: int = 12) -> DataFrame:
    """(a, b): a spanning forest of the plausible pairs of each bucket; all of them in buckets of at most so many classes.

    members: (key, i, j, rid, core, n_shingles, registers).
    """
    rows = members.select("key", "i", "j", "rid", "core", "n_shingles", "registers").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rid")

    def edges(c: list[np.ndarray]) -> pa.RecordBatch | None:
        key, i, j, rid, core, n, regs = c
        edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(key)]])
        size = np.diff(edge)
        place, total = np.arange(len(key)) - np.repeat(edge[:-1], size), np.repeat(size, size)
        few, a, b = (total <= small) & ~core, [], []
        for d in range(1, min(small, int(size.max()))):
            p = np.flatnonzero(few & (place + d < total))
            p = p[few[p + d]]
            if not len(p):
                break
            p = p[_plausible_pairs(p, p + d, n, regs, similarity)]
            a.append(p)
            b.append(p + d)
        for g in np.flatnonzero((size > small) | np.logical_or.reduceat(core, edge[:-1])):
            lo, hi = edge[g], edge[g + 1]
            found = np.array(_plausible_forest(core[lo:hi], n[lo:hi], regs[lo:hi], similarity), np.int64).reshape(-1, 2) + lo
            a.append(found[:, 0])
            b.append(found[:, 1])
        if not a or not len(a := np.concatenate(a)):
            return None
        x, y = rid[a], rid[np.concatenate(b)]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)  # many share several buckets
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)] + [_registers(batch.column(6))]
            if held:
                c = [np.concatenate([h, x]) for h, x in zip(held, c, strict=True)]
            last = np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]) | (c[2] != c[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut and (out := edges([x[:cut] for x in c])) is not None:
                yield out
            held = [x[cut:] for x in c]
        if held and (out := edges(held)) is not None:
            yield out

    return rows.mapInArrow(K.frees(run), "a long, b long")


def _near_lead(hot: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Rows (key, rid, lead) of hot buckets with core: whether similarity doesn't contradict the pair with the bucket's lead."""
    side = classes.select("rid", "n_shingles", "registers")
    both = hot.select("key", "rid", "lead").join(side, "rid").join(side.toDF("lead", "n_lead", "lead_registers"), "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y, n, m = _registers(b.column(4)), _registers(b.column(6)), b.column(3).to_numpy().astype(float), b.column(5).to_numpy().astype(float)
            _, near = plausible((x > y).sum(1), (x < y).sum(1), n, m, similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near)], names=["key", "rid", "lead", "core"])

    return both.select("key", "rid", "lead", "n_shingles", "registers", "n_lead", "lead_registers").mapInArrow(K.frees(run), "key long, rid long, lead long, core boolean")


def clusters(classes: DataFrame, similarity: float, block: int, scratch: shared.Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, component): classes that plausible pairs connect, and the crowded buckets (key, rid, lead, size)."""
    bands = _bands(classes)
    buckets = bands.groupBy("key").agg(F.min("rid").alias("lead"), F.count("*").alias("size")).where("size > 1")
    crowded = scratch.table(bands.join(buckets, "key"))
    members = crowded.where(F.col("size") <= block).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "rid", F.lit(False).alias("core"))
    hot, near = crowded.where(F.col("size") > block), None
    if not hot.isEmpty():
        near = scratch.table(_near_lead(hot, classes, similarity))
        split = _dealt(near.select("key", "rid", "core", F.lit(1).alias("one")), "key", "one", block)
        members = members.unionByName(split.drop("one"))
    edges = _bucket_edges(members.join(classes.select("rid", "n_shingles", "registers"), "rid"), similarity)
    if near is not None:
        edges = edges.unionByName(near.where("core and rid <> lead").select(F.least("rid", "lead").alias("a"), F.greatest("rid", "lead").alias("b")))
    return graph.components(edges, scratch), crowded


def _exact_labels(core: np.ndarray, values: np.ndarray, first: np.ndarray, share: int, cells: int = 1 << 22) -> np.ndarray:
    """A label for each set of a group: equal for those connected by pairs with 100 * intersection >= share * union.

    Shingles that one set alone has can't be common; the others are numbered, and sets are compared by products of 0/1 matrices.
    """
    forest, size = _Forest(core), np.diff(first).astype(np.int64)
    if len(size) == 2:
        common = len(np.intersect1d(values[: first[1]], values[first[1] :], assume_unique=True))
        if 100 * common >= share * (size.sum() - common):
            forest.join(0, np.array([1]))
        return forest.label
    _, number, many = np.unique(values, return_inverse=True, return_counts=True)
    use = many[number] > 1
    owner, number = np.repeat(np.arange(len(size)), size)[use], number[use]
    begin = np.searchsorted(owner, np.arange(len(size) + 1))
    width, column = 1, np.full(len(many), -1, np.int32)
    while len(rest := forest.open()):
        q = rest[:width]
        q = q[: max(1, int(np.searchsorted(np.cumsum(size[q]), 16384, side="right")))]
        own = np.unique(np.concatenate([number[begin[i] : begin[i + 1]] for i in q]))
        column[own] = np.arange(len(own))
        at = column[number]
        hit = np.flatnonzero(at >= 0)
        who, at = owner[hit], at[hit]
        column[own] = -1
        common = np.zeros((len(q), len(size)))
        if len(q) == 1:
            common[0] = np.bincount(who, minlength=len(size))
        elif len(own):
            mine = np.zeros((len(q), len(own)), np.float32)
            for r, i in enumerate(q):
                mine[r, np.searchsorted(own, number[begin[i] : begin[i + 1]])] = 1
            step = max(1, cells // len(own))
            cut = np.searchsorted(who, np.arange(0, len(size) + step, step))
            for k, lo in enumerate(range(0, len(size), step)):
                x, y = cut[k], cut[k + 1]
                if x < y:
                    theirs = np.zeros((min(step, len(size) - lo), len(own)), np.float32)
                    theirs[who[x:y] - lo, at[x:y]] = 1
                    common[:, lo : lo + len(theirs)] = mine @ theirs.T
        linked = 100 * common >= share * (size[q][:, None] + size[None, :] - common)
        forest.todo[q] = False
        for r, i in enumerate(q):
            forest.join(i, np.flatnonzero(linked[r]))
        width = min(64, 2 * width)
    return forest.label


def _cluster_links(rows: DataFrame, similarity: float, k: int) -> DataFrame:
    """(a, b): a spanning forest of the links between the texts of each group, decided on full sets.

    rows: (cluster, i, j, rid, core, t).
    """
    share = round(similarity * 100)
    dealt = rows.select("cluster", "i", "j", "rid", "core", "t").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rid")

    def links(rid: np.ndarray, core: np.ndarray, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if (again := rid[1:] == rid[:-1]).any():  # a repeated document
            keep = np.concatenate([[True], ~again])
            values = values[np.repeat(keep, np.diff(first))]
            first = np.concatenate([[0], np.cumsum(np.diff(first)[keep])])
            rid, core = rid[keep], core[keep]
        label = _exact_labels(core, values, first, share)
        lead = np.full(len(rid), -1)
        lead[label[::-1]] = np.arange(len(rid))[::-1]  # the first member of each component
        if core.any():
            lead[label[core][0]] = np.flatnonzero(core)[0]
        to = lead[label]
        new = (to != np.arange(len(rid))) & ~core
        return rid[new], rid[to[new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for whole in batches:
            for b in K.slices(whole, "t"):
                out = []
                values, first = shingle_sets(*K.utf8(b.column(5)), k)
                c, i, j, rid, core = (b.column(x).to_numpy(zero_copy_only=False) for x in range(5))
                edge = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(c)]])
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if (own := (c[x], i[x], j[x])) != key and held:
                        out.append(links(*_merged(held)))
                        held = []
                    key = own
                    held.append((rid[x:y], core[x:y], values[first[x] : first[y]].copy(), first[x : y + 1] - first[x]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])
        if held:
            a, b = links(*_merged(held))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(K.frees(run), "a long, b long")


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Pieces (rids, core, values, offsets) of one group as one."""
    if len(parts) == 1:
        return parts[0]
    rid, core, values, first = zip(*parts, strict=True)
    before = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return np.concatenate(rid), np.concatenate(core), np.concatenate(values), np.concatenate([*(f[:-1] + x for f, x in zip(first, before, strict=False)), before[-1:]])


def _linked(docs: DataFrame, doc: str, text: str, classes: DataFrame, similarity: float, k: int, block: int, block_shingles: int, scratch: shared.Scratch) -> DataFrame:
    """(node, component) of the classes that are linked with others."""
    cluster, crowded = clusters(classes, similarity, block, scratch)
    member = cluster.select(F.col("node").alias("rid"), F.col("component").alias("cluster")).join(classes.select("rid", "rep", "t64", "n_shingles"), "rid")
    weights = member.groupBy("cluster").agg(F.sum("n_shingles").alias("weight"))
    member = scratch.table(member.join(weights, "cluster"))
    columns = ["cluster", "i", "j", "rid", "core", "rep", "t64"]
    whole = member.where(F.col("weight") <= block_shingles).withColumns({"i": F.lit(0), "j": F.lit(0), "core": F.lit(False)}).select(*columns)
    hot, star = member.where(F.col("weight") > block_shingles), None
    if not hot.isEmpty():
        reach = crowded.groupBy("rid").agg(F.sum("size").alias("reach"))  # classes in the middle of a cluster share more buckets
        lead = hot.join(reach, "rid").groupBy("cluster").agg(F.max_by("rid", F.struct("reach", -F.col("rid"))).alias("lead"))
        led = scratch.table(hot.join(lead, "cluster"))
        texts = scratch.table(_once_a_task(_with_text(docs, led.select("rid", "rep", "t64"), doc, text).select("rid", "t"), ["rid"]).dropDuplicates(["rid"]))
        star = scratch.table(verify(led.where("rid <> lead").select(F.col("lead").alias("a"), F.col("rid").alias("b")), texts, similarity, k).where("linked").select("a", "b"))
        joined = led.join(star.select(F.col("b").alias("rid"), F.lit(True).alias("near")), "rid", "left")
        marked = joined.select("cluster", "rid", "rep", "t64", "n_shingles", F.coalesce("near", F.col("rid") == F.col("lead")).alias("core"))
        whole = whole.unionByName(_dealt(scratch.table(marked), "cluster", "n_shingles", block_shingles).select(*columns))
    wanted = scratch.table(whole)
    links = _cluster_links(_once_a_task(_with_text(docs, wanted, doc, text).select("cluster", "i", "j", "rid", "core", "t"), ["cluster", "i", "j", "rid"]), similarity, k)
    if star is None:  # every cluster was one group: what it gave are its components
        links = scratch.table(links)
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select("b", "b").distinct().toDF("node", "component"))
    return graph.components(links.unionByName(star), scratch)


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", similarity: float = 0.75, k: int = WORDS, block: int = 2048, block_shingles: int = 1 << 21) -> DataFrame:
    """(doc, n_shingles, component_id, kept) of every row: component_id is the smallest id connected by links of at least that similarity."""
    sets = ["n_shingles", "h1", "h2"]
    with shared.Scratch(docs.sparkSession) as scratch:
        rows = scratch.table(sketch(docs, doc, text, k))
        linkable = rows.where("n_shingles > 0 and __doc is not null")
        grouped = linkable.groupBy(*sets).agg(F.min(F.struct("__doc", "t64")).alias("rep"), F.first("registers").alias("registers"))
        classes = scratch.table(grouped.select(*sets, F.col("rep.__doc").alias("rep"), F.col("rep.t64").alias("t64"), "registers").withColumn("rid", F.monotonically_increasing_id()))
        labels = _linked(docs, doc, text, classes, similarity, k, block, block_shingles, scratch)
        named = classes.select(*sets, "rid", "rep").join(labels.withColumnRenamed("node", "rid"), "rid", "left")
        smallest = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("smallest"))
        named = named.join(smallest, "component", "left").select(*sets, F.coalesce("smallest", "rep").alias("component_id"))
        mine = rows.select("__doc", *sets).join(named, sets, "left")
        mine = shared.table(mine.select("__doc", "n_shingles", F.when(F.col("__doc").isNotNull(), F.coalesce("component_id", "__doc")).alias("component_id")))
    kept = F.coalesce(F.col("__doc") == F.col("component_id"), F.lit(True))
    return mine.select(F.col("__doc").alias(doc), "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", similarity: float = 0.75) -> DataFrame:
    """One row of each component, the first of those with the smallest id, and all rows without an id; same columns.

    The result is read from a copy of the rows in the shared folder, which numbers them.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    rows = shared.table(docs.withColumn(row, F.monotonically_increasing_id()))
    linked = near_duplicates(rows.where(F.col(f"`{doc}`").isNotNull()), row, text, similarity).select(row, "component_id")
    crowded = linked.groupBy("component_id").agg(F.count("*").alias("size")).where("size > 1").select("component_id")
    with shared.Scratch(docs.sparkSession) as scratch:
        members = scratch.table(linked.join(crowded, "component_id").join(rows.select(row, F.col(f"`{doc}`").alias("__id")), row))
        first = members.groupBy("component_id").agg(F.min(F.struct("__id", row))[row].alias("__first"))
        gone = shared.table(members.join(first, "component_id").where(F.col(row) != F.col("__first")).select(F.col(row).alias("__gone")))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(side, F.col(row) == F.col("__gone"), "left_anti").select(*[K._quoted(c) for c in docs.columns])


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
