"""Detection quality against gold annotations.

Gold and predicted spans are tables of (keys, entity_type, start, end).  Overlap measures are equi-joins on
the document with the interval condition on top; only the maximum matching runs in Python, per document.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from . import resolution

#: The least overlap of a match, and the least part of a span that must lie on gold.
LEAST_IOU, LEAST_SHARE = 0.5, 0.5
#: By how much thresholds are moved to compare ways of asking.
OFFSETS = (0.0, -0.2, -0.1, 0.1)
_WORD = re.compile(r"\w+")


def _overlap() -> Column:
    """Shared characters; least and greatest pass over nulls, so a missing side is told apart first."""
    return F.when(F.col("g.start").isNull() | F.col("p.start").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least("g.end", "p.end") - F.greatest("g.start", "p.start")))


def _iou() -> Column:
    return _overlap() / (F.greatest("g.end", "p.end") - F.least("g.start", "p.start"))


def _same(keys: list[str], *more: Column) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"g.{k}").eqNullSafe(F.col(f"p.{k}"))
    for c in more:
        on &= c
    return on


def near(gold: list[tuple[int, int]], predicted: list[tuple[int, int]]) -> list[list[int]]:
    """For each gold span, the predicted ones that overlap it enough.  Their starts lie within a reach that follows from its length."""
    order = sorted(range(len(predicted)), key=predicted.__getitem__)
    starts = [predicted[i][0] for i in order]
    out = []
    for a, b in gold:
        low, high = a - (1 / LEAST_IOU - 1) * (b - a), a + (1 - LEAST_IOU) * (b - a)
        row = []
        for i in order[bisect_left(starts, low) : bisect_right(starts, high)]:
            x, y = predicted[i]
            shared = min(b, y) - max(a, x)
            if shared > 0 and shared >= LEAST_IOU * (max(b, y) - min(a, x)):
                row.append(i)
        out.append(row)
    return out


def matched(choices: list[list[int]]) -> int:
    """How many of the left side can have a choice of their own at once.

    Phases: distances from the free ones, breadth first, then as many shortest augmenting paths as there are, depth first along these distances;
    both without recursion.  What a first pass in order assigns is where the phases begin.
    """
    mine, whose = [-1] * len(choices), {}
    for left, row in enumerate(choices):
        for right in row:
            if right not in whose:
                mine[left], whose[right] = right, left
                break
    while True:
        free = [left for left, right in enumerate(mine) if right < 0 and choices[left]]
        far, line, ends = [-1] * len(choices), list(free), False
        for left in free:
            far[left] = 0
        for left in line:  # grows
            for right in choices[left]:
                then = whose.get(right, -1)
                if then < 0:
                    ends = True
                elif far[then] < 0:
                    far[then] = far[left] + 1
                    line.append(then)
        if not ends:
            return len(whose)
        left_to_try = {left: iter(choices[left]) for left in line}
        for start in free:
            path = [start]
            while path:
                here = path[-1]
                for right in left_to_try[here]:
                    then = whose.get(right, -1)
                    if then < 0:
                        for left in reversed(path):
                            mine[left], right = right, mine[left]
                            whose[mine[left]] = left
                        path = []
                        break
                    if far[then] == far[here] + 1:
                        path.append(then)
                        break
                else:
                    far[path.pop()] = -1


#: Spans of one key and type that one task may match without their being cut into chains.
ONE_CHAIN = 1 << 14


def match_counts(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entity_type, tp, fp, fn): spans of one type match one to one if they overlap enough.

    Only spans that an unbroken chain of overlaps joins can be rivals.  Where a key has many spans of a type, they are cut into these chains by ranges, so
    a task holds a chain at most, and chains of one span, or of one on each side, need no matching.
    """
    names = [*keys, "entity_type"]
    place = [F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e")]
    spans = tables.table(gold.select(*names, *place, F.lit(True).alias("__gold")).unionByName(predicted.select(*names, *place, F.lit(False).alias("__gold"))))
    most = spans.groupBy(*names).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
    by = names
    if most > ONE_CHAIN:
        spans, by = resolution.chained(spans, names, "s", "e", "__chain"), [*names, "__chain"]
    side = F.struct("s", "e")
    both = spans.groupBy(*by).agg(F.collect_list(F.when(F.col("__gold"), side)).alias("gold"), F.collect_list(F.when(~F.col("__gold"), side)).alias("predicted")).drop("__chain")
    n, m = F.size("gold").cast("long"), F.size("predicted").cast("long")
    if most <= ONE_CHAIN:
        return _matching(both, names)
    g, p = F.col("gold")[0], F.col("predicted")[0]
    shared = F.least(g["e"], p["e"]) - F.greatest(g["s"], p["s"])
    hit = ((shared > 0) & (shared >= LEAST_IOU * (F.greatest(g["e"], p["e"]) - F.least(g["s"], p["s"])))).cast("long")
    tp = F.when((n == 0) | (m == 0), F.lit(0).cast("long")).otherwise(hit)
    both = tables.table(both.withColumn("__easy", (n == 0) | (m == 0) | ((n == 1) & (m == 1))))
    easy = both.where("__easy").select(*names, tp.alias("tp"), (m - tp).alias("fp"), (n - tp).alias("fn"))
    each = easy.unionByName(_matching(both.where("not __easy").drop("__easy"), names))
    return each.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def _matching(both: DataFrame, names: list[str]) -> DataFrame:
    """(names, tp, fp, fn) of each row's gold and predicted spans."""
    schema = T.StructType([both.schema[k] for k in names] + [T.StructField(n, T.LongType()) for n in ("tp", "fp", "fn")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tp, fp, fn = [], [], []
            for gs, ps in zip(b.column("gold").to_pylist(), b.column("predicted").to_pylist(), strict=True):
                gs, ps = ([(x["s"], x["e"]) for x in side or ()] for side in (gs, ps))
                n = matched(near(gs, ps))
                tp.append(n)
                fp.append(len(ps) - n)
                fn.append(len(gs) - n)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), *(pa.array(x, pa.int64()) for x in (tp, fp, fn))], names=schema.names)

    return both.mapInArrow(run, schema)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by type (or other columns); a ratio over nothing is 0."""
    total = counts.groupBy(*(["entity_type"] if by is None else by)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    total = total.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return total.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(counts: DataFrame, tier_1: Iterable[str]) -> DataFrame:
    """One row: micro scores, and recall over the types of tier 1."""
    first = counts.where(F.col("entity_type").isin(*tier_1)).agg(_ratio(F.sum("tp"), F.sum("tp") + F.sum("fn")).alias("tier_1_recall"))
    return scores(counts, []).crossJoin(first)  # one row each


def failing(by_type: DataFrame, types: Iterable[str], least: float = 0.8) -> DataFrame:
    """Types of the run whose precision is below the target."""
    return by_type.where(F.col("entity_type").isin(*types) & (F.col("precision") < least)).select("entity_type", "precision")


def coverage(gold: DataFrame, predicted: DataFrame, keys: list[str], types: Iterable[str]) -> DataFrame:
    """(keys, entity_type, start, end, covered) of each gold span of the group: whether any span of the group overlaps it enough."""
    names = list(types)
    g, p = gold.where(F.col("entity_type").isin(*names)).alias("g"), predicted.where(F.col("entity_type").isin(*names)).alias("p")
    hit = g.join(p, _same(keys, _iou() >= LEAST_IOU), "left_semi").select(*keys, "entity_type", "start", "end").distinct().withColumn("covered", F.lit(True))
    own = [*keys, "entity_type", "start", "end"]
    return gold.where(F.col("entity_type").isin(*names)).select(*own).join(hit, own, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def covered_buckets(covered: DataFrame, by: list[str]) -> DataFrame:
    """(by..., covered, gold, ratio, dark): coverage in each bucket, and a last row, with nulls, over all of them.

    dark: a bucket of which nothing at all is covered, which the overall ratio cannot show.
    """
    rows = covered.rollup(*by).agg(F.grouping_id().alias("__level"), F.sum(F.col("covered").cast("long")).alias("covered"), F.count("*").alias("gold"))
    whole = (1 << len(by)) - 1
    rows = rows.where(F.col("__level").isin(0, whole))
    return rows.select(*by, "covered", "gold", _ratio(F.col("covered"), F.col("gold")).alias("ratio"), ((F.col("covered") == 0) & (F.col("__level") == 0)).alias("dark"))


def over_masking(gold: DataFrame, predicted: DataFrame, keys: list[str], types: Iterable[str]) -> DataFrame:
    """(entity_type, on_gold, total): predictions that lie on gold of any type for at least half of them."""
    chosen = predicted.where(F.col("entity_type").isin(*types)).withColumn("__id", F.monotonically_increasing_id())
    pairs = chosen.alias("p").join(gold.alias("g"), _same(keys, F.col("g.start") < F.col("p.end"), F.col("p.start") < F.col("g.end")), "left")
    each = pairs.groupBy("p.__id", "p.entity_type", "p.start", "p.end").agg(F.sum(F.coalesce(_overlap(), F.lit(0))).alias("covered"))
    return each.groupBy("entity_type").agg(F.sum((F.col("covered") >= LEAST_SHARE * (F.col("end") - F.col("start"))).cast("long")).alias("on_gold"), F.count("*").alias("total"))


def unmasked_words(texts: DataFrame, gold: DataFrame, predicted: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, entity_type, start, end, word, place) of the words of gold spans that spans don't cover whole."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.collect_list(F.struct("entity_type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias(name))

    rows = texts.select(*keys, F.col(text).alias("__text")).join(side(gold, "__gold"), keys).join(side(predicted, "__found"), keys, "left")
    schema = T.StructType([texts.schema[k] for k in keys] + [T.StructField("entity_type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("word", T.StringType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for row, (t, gs, ps) in enumerate(zip(b.column("__text").to_pylist(), b.column("__gold").to_pylist(), b.column("__found").to_pylist(), strict=True)):
                hidden = bytearray(len(t or ""))
                for p in ps or []:
                    hidden[p["start"] : p["end"]] = b"\1" * (min(p["end"], len(hidden)) - p["start"])
                for g in gs:
                    for m in _WORD.finditer(t or "", g["start"], g["end"]):
                        if not all(hidden[m.start() : m.end()]):
                            at.append(row)
                            out.append((g["entity_type"], g["start"], g["end"], m[0], m.start()))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in keys), pa.array(c[0]), pa.array(c[1]), pa.array(c[2]), pa.array(c[3]), pa.array(c[4])], names=schema.names)

    return rows.mapInArrow(run, schema)


def leaks_against(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Differences between leaks found and leaks on record, (entity_type, value, side)."""
    cols = ["entity_type", "value"]
    return found.select(*cols).exceptAll(recorded.select(*cols)).withColumn("side", F.lit("new")).unionByName(recorded.select(*cols).exceptAll(found.select(*cols)).withColumn("side", F.lit("gone")))


def percentiles(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and nearest-rank 95th percentile of timings."""
    return samples.groupBy(*by).agg(F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"))


def document_leaks(documents: DataFrame, key: str = "id", **options) -> tuple[DataFrame, DataFrame]:
    """(leaks, refused) of annotated documents, searched as one text of their leaves.

    documents: (key, leaves), a leaf with key, text and entities (entity_type, start, end in the text).  leaks: (key, leaf, start,
    entity_type, value) of gold spans with a word that isn't hidden; refused: (key, error_class) of documents in which a finding reaches over leaves.
    """
    from . import jsontext
    from .detection import Finder

    schema = T.StructType([documents.schema[key], T.StructField("leaf", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("entity_type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("error_class", T.StringType())])

    def leaks(leaves: list[dict], find: Finder) -> Iterator[tuple]:
        joined = jsontext.join([jsontext.Leaf(x["key"], "string", x["text"] or "") for x in leaves])
        hidden = bytearray(len(joined.text))
        for leaf, a, b, _ in jsontext.split(joined, [(s.start, s.end, s.entity_type) for s in find(joined.text)]):
            at = joined.ranges[leaf][0]
            hidden[at + a : at + b] = b"\1" * (b - a)
        for i, x in enumerate(leaves):
            at = joined.ranges[i][0]
            for g in x["entities"] or ():
                if any(not all(hidden[m.start() : m.end()]) for m in _WORD.finditer(joined.text, at + g["start"], at + g["end"])):
                    yield i, g["start"], g["entity_type"], x["text"][g["start"] : g["end"]], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(**options)
        for b in batches:
            at, out = [], []
            for row, leaves in enumerate(b.column(1)):
                try:
                    found = list(leaks(leaves.as_py() or [], find))
                except jsontext.Refused as e:
                    found = [(None, None, None, None, str(e))]
                at += [row] * len(found)
                out += found
            c = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(c, types, strict=True))], names=schema.names)

    rows = documents.select(key, "leaves").mapInArrow(run, schema)
    return rows.where("error_class is null").drop("error_class"), rows.where("error_class is not null").select(key, "error_class")


def leak_figures(leaks: DataFrame) -> DataFrame:
    """One row: occurrences, and distinct entities (type and value)."""
    return leaks.agg(F.count("*").alias("occurrences"), F.count_distinct("entity_type", "value").alias("entities"))


def lost(together: Column, apart: Column) -> Column:
    """Findings of parts searched together that are missing when each is searched alone."""
    return F.array_except(together, apart)


#: A prime, and the numbers that mix a group's key with a resample's number below it; fifth powers permute what is below it.
_PRIME, _BY_GROUP, _BY_RESAMPLE, _AGAIN = (1 << 31) - 1, 48271, 69621, 16807
#: How probable at most so many draws of a group are (Poisson with mean 1); more than eight are rarer than one in a million.
_AT_MOST = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(8)]


def draws(groups: np.ndarray, resamples: np.ndarray, seed: int) -> np.ndarray:
    """How often each group (keys below the prime) is drawn in each resample; it depends on nothing else."""

    def fifth(h: np.ndarray) -> np.ndarray:
        square = h * h % _PRIME
        return square * square % _PRIME * h % _PRIME

    h = fifth((groups.astype(np.int64) * _BY_GROUP + seed) % _PRIME)[:, None]
    h = fifth((h + resamples.astype(np.int64)[None, :] * _BY_RESAMPLE) % _PRIME)
    return np.searchsorted(_AT_MOST, (fifth((h * _AGAIN + 7) % _PRIME) + 0.5) / _PRIME)


def resampled(measured: DataFrame, group: str, arm: str, counts: list[str], resamples: int = 2000, seed: int = 1, block: int = 256) -> DataFrame:
    """(arm, resample, counts...): the counts of each arm summed over the groups, weighed by how often each resample draws them.

    measured: a row for each group and arm.  Each task multiplies its rows' counts with the matrix of their draws, a block of rows at a time, and gives one row
    of sums for each arm; these are added by arm.  So what is shuffled are as many rows as there are tasks and arms, whatever the resamples.
    """
    integral = isinstance(measured.schema[group].dataType, (T.LongType, T.IntegerType))
    key = F.pmod(F.col(f"`{group}`").cast("long") if integral else F.xxhash64(F.col(f"`{group}`")), F.lit(_PRIME)).alias("g")
    rows = measured.select(key, F.col(f"`{arm}`").alias("arm"), *[F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(f"c{i}") for i, c in enumerate(counts)])
    numbers = np.arange(1, resamples + 1)
    schema = T.StructType([T.StructField("arm", rows.schema["arm"].dataType), T.StructField("sums", T.BinaryType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None
        for whole in batches:
            kind = whole.schema.field(1).type
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                drawn = draws(b.column(0).to_numpy(), numbers, seed)
                values = np.stack([b.column(2 + i).to_numpy() for i in range(len(counts))])
                names = b.column(1).to_pylist()
                for name in set(names):
                    own = np.array([x == name for x in names])
                    sums[name] = sums.get(name, 0) + values[:, own] @ drawn[own]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array([x.astype(np.int64).tobytes() for x in sums.values()], pa.binary())], names=schema.names)

    out = T.StructType([schema["arm"], T.StructField("resample", T.LongType()), *(T.StructField(f"c{i}", T.LongType()) for i in range(len(counts)))])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64).reshape(len(counts), resamples) for x in parts.column("sums").to_pylist())
        names = pa.array([parts.column("arm")[0].as_py()] * resamples, parts.schema.field("arm").type)
        return pa.table([names, pa.array(numbers), *(pa.array(x) for x in total)], names=out.names)

    merged = rows.mapInArrow(weigh, schema).groupBy("arm").applyInArrow(add, out)
    return merged.select(F.col("arm").alias(arm), "resample", *[F.col(f"c{i}").alias(c) for i, c in enumerate(counts)])


def bootstrap(measured: DataFrame, group: str, arm: str, count: str | list[tuple[str, bool]], resamples: int = 2000, seed: int = 1) -> DataFrame:
    """(arm, wins, undecided): in how many resamples of the groups the selection picks each arm alone, and in how many it can't tell two or more apart.

    count: what the selection goes by, the first first, each with whether more of it is better (a name alone: more is).  It is made again in each resample.
    """
    rule = [(count, True)] if isinstance(count, str) else count
    sums = resampled(measured, group, arm, [c for c, _ in rule], resamples, seed)
    merit = F.struct(*[(F.col(f"`{c}`") if more else -F.col(f"`{c}`")).alias(f"m{i}") for i, (c, more) in enumerate(rule)])
    scored = sums.select("resample", F.col(f"`{arm}`").alias("a"), merit.alias("merit"))
    best = scored.groupBy("resample").agg(F.max("merit").alias("best"))
    winners = scored.join(best, "resample").where(F.col("merit") == F.col("best")).groupBy("resample").agg(F.first("a").alias("a"), F.count("*").alias("many"))
    undecided = winners.agg(F.coalesce(F.sum((F.col("many") > 1).cast("long")), F.lit(0)).alias("undecided"))  # one row
    wins = winners.where("many = 1").groupBy("a").agg(F.count("*").alias("wins"))
    arms = measured.select(F.col(f"`{arm}`").alias("arm")).distinct()
    return arms.join(wins, F.col("arm").eqNullSafe(F.col("a")), "left").crossJoin(undecided).select(F.col("arm").alias(arm), F.coalesce("wins", F.lit(0)).alias("wins"), "undecided")


def frontier(shapes: DataFrame, found: str = "found", over_masked: str = "over_masked") -> DataFrame:
    """shapes with dominated: whether another way of asking finds at least as much and masks no more beside it, one of them better."""
    a, b = shapes.alias("a"), shapes.select(F.col(found).alias("__found"), F.col(over_masked).alias("__over")).distinct()
    as_good = (F.col("__found") >= F.col(found)) & (F.col("__over") <= F.col(over_masked))
    better = (F.col("__found") > F.col(found)) | (F.col("__over") < F.col(over_masked))
    beaten = a.join(F.broadcast(b), as_good & better, "left_semi").select(F.col(found).alias("__f"), F.col(over_masked).alias("__o")).distinct().withColumn("__beaten", F.lit(True))  # a handful of shapes
    return shapes.join(beaten, (F.col(found) == F.col("__f")) & (F.col(over_masked) == F.col("__o")), "left").select(*shapes.columns, F.coalesce("__beaten", F.lit(False)).alias("dominated"))


def asked(gold: DataFrame, answers: DataFrame, calls: DataFrame, keys: list[str], offsets: tuple[float, ...] = OFFSETS) -> DataFrame:
    """(shape, offset, found, over_masked, elapsed) of each way of asking a model, with every threshold moved by each offset.

    answers: (keys, shape, start, end, score, threshold) of every span that was scored, those below their threshold too; calls: (shape, seconds).
    A gold span is found if a span holds it whole, of whatever type; a span over-masks if it touches no gold.  Moved thresholds stay between 0.01 and
    0.99.  Spans are joined once for all offsets: what each passes is a mask of bits, and masks of a gold span are or-ed.  Repeated gold counts once,
    spans without a score pass nothing, and a shape that only calls know has found nothing.
    """
    bars = [F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("threshold") + F.lit(o))), 9) for o in offsets]
    mask = sum((F.when(F.col("score") >= bar, 1 << i).otherwise(0) for i, bar in enumerate(bars)), F.lit(0).cast("long"))
    said = answers.select(*keys, "shape", "start", "end", mask.alias("__mask")).where("__mask > 0")
    own = [*keys, "entity_type", "start", "end"]
    g, p = gold.select(*own).distinct().alias("g"), said.alias("p")
    held = g.join(p, _same(keys, F.col("p.start") <= F.col("g.start"), F.col("p.end") >= F.col("g.end"))).groupBy(*[F.col(f"g.{c}") for c in own], F.col("p.shape").alias("shape")).agg(F.bit_or("p.__mask").alias("__mask"))
    beside = p.join(g, _same(keys, F.col("g.start") < F.col("p.end"), F.col("p.start") < F.col("g.end")), "left_anti")

    def bits(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("shape").agg(*[F.sum(F.shiftright("__mask", i).bitwiseAND(1)).alias(f"{name}{i}") for i in range(len(offsets))])

    parts = bits(held, "found").unionByName(bits(beside, "over"), True).unionByName(calls.groupBy("shape").agg(F.sum("seconds").alias("elapsed")), True).unionByName(answers.select("shape").distinct(), True)
    names = [f"{name}{i}" for name in ("found", "over") for i in range(len(offsets))]
    whole = parts.groupBy("shape").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.sum("elapsed").alias("elapsed"))
    rows = F.array(*[F.struct(F.lit(float(o)).alias("offset"), F.col(f"found{i}").alias("found"), F.col(f"over{i}").alias("over_masked")) for i, o in enumerate(offsets)])
    return whole.select("shape", F.explode(rows).alias("r"), "elapsed").select("shape", "r.*", "elapsed")


def dominating(asked: DataFrame, shipped: str) -> DataFrame:
    """asked with dominates: whether another shape, at that offset, finds at least what the shipped one does as it is, and over-masks no more."""
    bar = asked.where((F.col("shape") == shipped) & (F.col("offset") == 0)).agg(F.max("found").alias("__found"), F.max("over_masked").alias("__over"))  # one row
    as_good = (F.col("shape") != shipped) & (F.col("found") >= F.col("__found")) & (F.col("over_masked") <= F.col("__over"))
    return asked.crossJoin(bar).select(*asked.columns, F.coalesce(as_good, F.lit(False)).alias("dominates"))


def metrics(by_type: DataFrame, total: DataFrame, **more: object) -> str:
    """The figures of a run as one JSON object: scores by type, micro scores, and whatever else is told (digests, targets, leak figures)."""
    round_ = {"precision": 3, "recall": 3, "f1": 3}
    types = {r["entity_type"]: {k: round(r[k], round_[k]) if k in round_ else r[k] for k in ("precision", "recall", "f1", "tp", "fp", "fn")} for r in by_type.collect()}  # a row for each type
    return json.dumps({"per_type": types, "total": total.first().asDict(), **more}, indent=2, sort_keys=True) + "\n"
