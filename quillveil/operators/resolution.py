"""Overlapping findings become disjoint ones that cover at least as much.

Two forms.  ``settle`` works on the spans of one text and decides who names each merged span; it runs
inside the detection UDF, so resolving costs no shuffle.  ``islands`` gives the resolved extents alone
with window functions, for span tables at rest: they are the connected components of the overlap graph.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from . import scans
from .spans import ARROW_SPANS, SPANS_TYPE, Span, order


class Decision(NamedTuple):
    rule: str
    kept: Span
    dropped: tuple[Span, ...]


def checksummed(s: Span) -> bool:
    """Spans whose identity no other finding may take."""
    return s.confidence >= 1.0 and s.recognizer.startswith("catalog:")


class Pair:
    """Two overlapping spans and what the rules ask about them."""

    def __init__(self, a: Span, b: Span, specificity: Mapping[str, int], untouchable: Callable[[Span], bool]):
        self.a, self.b, self.fixed, self._specificity = a, b, {id(s): untouchable(s) for s in (a, b)}, specificity
        self.outer, self.inner = self._nesting()

    def _nesting(self) -> tuple[Span | None, Span | None]:
        for outer, inner in ((self.a, self.b), (self.b, self.a)):
            if outer.start <= inner.start and inner.end <= outer.end and (outer.start, outer.end) != (inner.start, inner.end):
                return outer, inner
        return None, None

    def rank(self, s: Span) -> int:
        return self._specificity.get(s.entity_type, 0)

    def has(self, s: Span | None) -> bool:
        return s is not None and self.fixed[id(s)]

    def surer(self) -> Span:
        return self.b if self.b.confidence > self.a.confidence else self.a

    def only_fixed(self) -> Span | None:
        """The one that no other may name, if exactly one is."""
        return None if self.has(self.a) == self.has(self.b) else self.a if self.has(self.a) else self.b

    def more_sensitive(self, first: Span, second: Span) -> Span:
        return second if second.tier < first.tier else first

    def inner_leads_by(self, criterion: str) -> bool:
        """Whether, both being fixed, the inner one comes first by this criterion and the two are equal in those before it."""
        if not (self.has(self.outer) and self.has(self.inner)):
            return False
        for name, value in (("specificity", self.rank), ("confidence", lambda s: s.confidence), ("sensitivity", lambda s: -s.tier)):
            if value(self.inner) != value(self.outer):
                return name == criterion and value(self.inner) > value(self.outer)
        return False


def _nested_by(criterion: str) -> tuple[str, Callable[[Pair], bool], Callable[[Pair], Span]]:
    return f"nested-{criterion}-merge", lambda p: p.inner_leads_by(criterion), lambda p: p.inner


#: The rules in their order: a name, when it holds, and whose identity the union takes.  In the first only, the surer one's confidence
#: goes along; in the one marked so, the outer span stays as it is.
OUTER_WINS = "nesting-outer-wins"
SAME_TYPE = "same-type-merge"
RULES: tuple[tuple[str, Callable[[Pair], bool], Callable[[Pair], Span]], ...] = (
    (SAME_TYPE, lambda p: p.a.entity_type == p.b.entity_type, lambda p: p.only_fixed() or p.surer()),
    ("untouchable-inner-merge", lambda p: p.has(p.inner) and not p.has(p.outer), lambda p: p.more_sensitive(p.inner, p.outer)),
    ("specific-inner-merge", lambda p: p.inner is not None and not p.has(p.outer) and p.rank(p.inner) > p.rank(p.outer), lambda p: p.inner),
    _nested_by("specificity"),
    _nested_by("confidence"),
    _nested_by("sensitivity"),
    (OUTER_WINS, lambda p: p.inner is not None, lambda p: p.outer),
    ("untouchable-wins", lambda p: p.only_fixed() is not None, lambda p: p.only_fixed()),
    ("specificity", lambda p: p.rank(p.a) != p.rank(p.b), lambda p: max(p.a, p.b, key=p.rank)),
    ("confidence", lambda p: p.a.confidence != p.b.confidence, lambda p: p.surer()),
    ("tie-merge-sensitive", lambda p: True, lambda p: p.more_sensitive(p.a, p.b)),
)


class Referee:
    """Names the union of two overlapping spans by the first rule that holds."""

    def __init__(self, specificity: Mapping[str, int], untouchable: Callable[[Span], bool] = checksummed):
        self.specificity, self.untouchable = specificity, untouchable

    def decide(self, a: Span, b: Span) -> tuple[Span, str]:
        pair = Pair(a, b, self.specificity, self.untouchable)
        name, _, named = next(r for r in RULES if r[1](pair))
        by = named(pair)
        if name == OUTER_WINS:
            return by, name
        if name == SAME_TYPE:
            by = by._replace(confidence=pair.surer().confidence, boosted=pair.surer().boosted)
        return by._replace(start=min(a.start, b.start), end=max(a.end, b.end)), name


def settle(spans: Iterable[Span], specificity: Mapping[str, int], untouchable: Callable[[Span], bool] = checksummed, trace: list[Decision] | None = None) -> list[Span]:
    """Disjoint spans in order.  The first two that overlap, in the order of spans, are merged until none do."""
    referee = Referee(specificity, untouchable)
    line = sorted(set(spans), key=order)
    at = 0
    while at + 1 < len(line):
        a, b = line[at], line[at + 1]
        if b.start >= a.end:  # as starts ascend, nothing further on overlaps a
            at += 1
            continue
        kept, rule = referee.decide(a, b)
        if trace is not None:
            trace.append(Decision(rule, kept, tuple(s for s in (a, b) if s != kept)))
        del line[at : at + 2]
        if kept not in line:
            insort(line, kept, key=order)
        at = 0 if at == 0 else at - 1
    return line


def settled(df: DataFrame, specificity: Mapping[str, int], spans: str = "spans", keep: list[str] | None = None, untouchable: Callable[[Span], bool] = checksummed) -> DataFrame:
    """The kept columns (all others, unless named) and the array of spans of each row, resolved; a null array has none."""
    keep = [c for c in (df.columns if keep is None else keep) if c != spans]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(spans, SPANS_TYPE)])
    names = Span._fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[s._asdict() for s in settle((Span(*(x[n] for n in names)) for x in row or ()), specificity, untouchable)] for row in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, ARROW_SPANS)], names=schema.names)

    return df.select(*keep, F.col(spans).cast(SPANS_TYPE)).mapInArrow(run, schema)


#: Rows of one key that a single window may order; beyond, keys are cut into ranges.
ONE_WINDOW = 1 << 20


def islands(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", one_window: int = ONE_WINDOW) -> DataFrame:
    """(keys, start, end, spans) of the connected components of overlap; spans that only touch stay apart.

    A span opens an island if it begins where all before it have ended, and an island is known by its first start.  Where a key has over one_window
    rows, both running maxima are taken over ranges, so that no task orders a whole key.
    """
    own = spans.select(*keys, F.col(start).alias("__start"), F.col(end).alias("__end"))
    most = own.groupBy(*keys).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
    if most > one_window:
        line = chained(own, keys, "__start", "__end", "__island")
    else:
        order = Window.partitionBy(*keys).orderBy("__start", "__end")
        line = own.withColumn("__before", F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__opens", _opens("__start"))
        line = line.withColumn("__island", F.max("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # an empty span may open an island where another one begins, at the same start
    return line.groupBy(*keys, "__island").agg(F.min("__start").alias(start), F.max("__end").alias(end), F.count("*").alias("spans")).drop("__island")


def _opens(start: str) -> Column:
    return F.when(F.coalesce(F.col(start) >= F.col("__before"), F.lit(True)), F.col(start))


def chained(spans: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """spans with name: the first start of the island that each one belongs to, found by ranges, so that no task orders a whole key."""
    cut = scans.Ranges(spans, keys, [start, end])
    line = cut.running(cut.rows, "__before", F.max, F.col(end), current=False).withColumn("__opens", _opens(start))
    return cut.running(line, name, F.max, F.col("__opens")).drop("__before", "__opens", cut.part)


def _level(start: Column, end: Column) -> Column:
    """The power of two that is the smallest bin of at least a span's length (an empty one counts as one place)."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int")


def _bin(place: Column, level: Column) -> Column:
    return F.floor(place / F.pow(F.lit(2.0), level)).cast("long")  # exact for places below 2**53


def overlapping(coarse: DataFrame, fine: DataFrame, keys: list[str], finer_only: bool = False) -> DataFrame:
    """(keys, a, b) for spans a of coarse and b of fine that each begin before the other ends, b on a's level or a finer one (or on finer ones only).

    An empty span lies within those that begin before it and end behind it.

    Both: (keys, span), span a struct with start and end.  A level's bins are as wide as its longest spans, so a span lies in two bins of its
    own level at most; spans look their partners up in the bins of all coarser levels that there are.  A pair belongs to the bin in which what it shares begins.
    """
    a, b = (df.withColumn("__own", _level(F.col("span.start"), F.col("span.end"))) for df in (coarse, fine))
    levels = sorted(r[0] for r in a.select("__own").distinct().collect())  # 64 at most
    at = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > F.col("__own") if finer_only else x >= F.col("__own"))

    def bins(level: Column) -> Column:
        return F.explode(F.sequence(_bin(F.col("span.start"), level), _bin(F.greatest(F.col("span.end") - 1, F.col("span.start")), level)))

    owners = a.select(*keys, "span", F.col("__own").alias("__level")).withColumn("__bin", bins(F.col("__level"))).withColumnRenamed("span", "a")
    asking = b.select(*[F.col(f"`{k}`").alias(f"__q{i}") for i, k in enumerate(keys)], "span", F.explode(at).alias("__at")).withColumn("__in", bins(F.col("__at"))).withColumnRenamed("span", "b")
    on = (F.col("__level") == F.col("__at")) & (F.col("__bin") == F.col("__in"))
    for i, k in enumerate(keys):
        on &= F.col(f"`{k}`").eqNullSafe(F.col(f"__q{i}"))
    first = F.greatest("a.start", "b.start")
    meet = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return owners.join(asking, on).where(meet & (_bin(first, F.col("__level")) == F.col("__bin"))).select(*keys, "a", "b")


def pairs(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", id_: str = "id") -> DataFrame:
    """(keys, a, b, relation) of the spans that each begin before the other ends, a before b by id: overlap, same, or which one holds the other."""
    own = spans.select(*keys, F.struct(F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.col(id_).alias("id")).alias("span"))
    both = overlapping(own, own, keys)
    finer = _level(F.col("b.start"), F.col("b.end")) < _level(F.col("a.start"), F.col("a.end"))
    both = both.where(finer | (F.col("a.id") < F.col("b.id")))  # on one level each pair is met from both sides
    turned = F.col("a.id") < F.col("b.id")
    x, y = (F.when(turned, F.col(p)).otherwise(F.col(q)) for p, q in (("a", "b"), ("b", "a")))
    both = both.where(F.col("a.id") != F.col("b.id")).select(*keys, x.alias("a"), y.alias("b"))
    holds = (F.col("a.start") <= F.col("b.start")) & (F.col("b.end") <= F.col("a.end"))
    inside = (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    relation = F.when(holds & inside, "same").when(holds, "a holds b").when(inside, "b holds a").otherwise("overlap")
    return both.select(*keys, F.col("a.id").alias("a"), F.col("b.id").alias("b"), relation.alias("relation"))


#: Spans of a key that one task counts pairs of, and pairs that are compared one by one.
SPANS_AT_ONCE, FEW_PAIRS = 1 << 17, 1 << 12
_RELATIONS = {("same", True): "same", ("holds", True): "a holds b", ("holds", False): "b holds a", ("overlap", True): "overlap", ("overlap", False): "overlap"}


class Tally:
    """Counts pairs of spans and sums their ids.  Spans are columns start, end, id of an array, in the order of relation_counts."""

    def __init__(self):
        self.sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

    def _add(self, kind: str, forth: bool, x: np.ndarray, of_x: np.ndarray, y: np.ndarray, of_y: np.ndarray) -> None:
        """of_x, of_y: how many pairs of this kind each span is in; forth: the ids of x come first."""
        if not (n := int(of_x.sum())):
            return
        first, second = _weighed(x[2], of_x, n), _weighed(y[2], of_y, n)
        total = self.sums[_RELATIONS[kind, forth]]
        for i, v in enumerate((n, first if forth else second, second if forth else first)):
            total[i] += v

    def within(self, s: np.ndarray) -> None:
        """Pairs of spans that are in order."""
        n = s.shape[1]
        if n * n > 4 * FEW_PAIRS:
            x, y = s[:, : n // 2], s[:, n // 2 :]
            self.within(x)
            self.within(y)
            self.between(x, y)
        elif n > 1:
            self._each(s, s, np.triu(np.ones((n, n), bool), 1))

    def between(self, x: np.ndarray, y: np.ndarray) -> None:
        """Pairs of spans x with spans y, all of which come after them."""
        if x.shape[1] and y.shape[1]:
            x = x[:, x[1] > y[0].min()]
        if x.shape[1]:
            y = y[:, y[0] < x[1].max()]
        if not x.shape[1] or not y.shape[1]:
            return
        if x.shape[1] * y.shape[1] <= FEW_PAIRS:
            self._each(x, y, np.ones((x.shape[1], y.shape[1]), bool))
        elif x[2].max() < y[2].min():
            self._resolved(x, y, True)
        elif x[2].min() > y[2].max():
            self._resolved(x, y, False)
        elif (low := min(int(x[2].min()), int(y[2].min()))) < (high := max(int(x[2].max()), int(y[2].max()))):  # equal ids are no pairs
            middle = (low + high) // 2
            (x0, x1), (y0, y1) = ((s[:, s[2] <= middle], s[:, s[2] > middle]) for s in (x, y))
            self.between(x0, y1)
            self.between(x1, y0)
            self.between(x0, y0)
            self.between(x1, y1)

    def _each(self, x: np.ndarray, y: np.ndarray, asked: np.ndarray) -> None:
        meet = asked & (x[1][:, None] > y[0])
        holds = meet & (x[1][:, None] >= y[1])
        same = holds & (x[1][:, None] == y[1]) & (x[0][:, None] == y[0])
        back = meet & (x[2][:, None] > y[2])
        for forth, ids in ((True, meet & (x[2][:, None] < y[2])), (False, back)) if back.any() else ((True, meet & (x[2][:, None] < y[2])),):
            for kind, pairs in (("same", same & ids), ("holds", (holds ^ same) & ids), ("overlap", (meet ^ holds) & ids)):
                if pairs.any():
                    self._add(kind, forth, x, pairs.sum(1), y, pairs.sum(0))

    def _resolved(self, x: np.ndarray, y: np.ndarray, forth: bool) -> None:
        """All ids of x come before those of y, or after them."""
        x = x[:, x[1].argsort(kind="stable")]
        n = x.shape[1]
        meet = x[1].searchsorted(y[0], "right")  # from there on spans end after y begins
        holds = np.maximum(meet, x[1].searchsorted(y[1], "left"))
        # as x comes before y in order, the one extent that both may have is the first of y, and equal ones are in the order of their ids
        alike_x, alike_y = ((s[0] == y[0, 0]) & (s[1] == y[1, 0]) & (s[1] > s[0]) for s in (x, y))
        same_x, same_y = alike_x * int(alike_y.sum()), alike_y * int(alike_x.sum())
        self._add("same", forth, x, same_x, y, same_y)
        self._add("holds", forth, x, np.bincount(holds, minlength=n + 1)[:n].cumsum() - same_x, y, n - holds - same_y)
        self._add("overlap", forth, x, (np.bincount(meet, minlength=n + 1) - np.bincount(holds, minlength=n + 1))[:n].cumsum(), y, holds - meet)


def _weighed(ids: np.ndarray, counts: np.ndarray, n: int) -> int:
    """The sum of ids times counts, of which there are n; by parts where it might overflow."""
    if n * max(int(ids.max()), -int(ids.min())) < 1 << 62:
        return int(ids @ counts)
    return sum(int(((ids >> by) & 0xFFFFF if by < 60 else ids >> by) @ counts) << by for by in (0, 20, 40, 60))


def relation_counts(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", id_: str = "id") -> DataFrame:
    """(keys, relation, pairs, a, b): how many rows of pairs there are of each relation, and the sums of their ids (whole numbers; decimals), without making them.

    Spans are ordered by where they begin, longer ones first, those without a length before all, then by id; so of two that meet the earlier one holds the later one, is the same, or
    is overlapped.  The line is cut into ranges.  A range counts the pairs within it by halves: of the spans of one half only those that reach the other are looked
    at, and where their ids are apart, two binary searches count them all.  Spans that reach later ranges are sent to each of those; a range that many
    reach is given out in parts, so no task has more than a fixed number of spans.  The work follows the spans and how many ranges they reach, not the pairs.
    """
    a, b = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    named = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keys)]
    own = spans.select(*named, F.least(a, b).alias("__place"), (b > a).alias("__long"), (-b).alias("__back"), F.col(f"`{id_}`").cast("long").alias("__id"), a.alias("__start"), b.alias("__end"))
    own, named = own.where("__start is not null and __end is not null and __id is not null"), [f"__k{i}" for i in range(len(keys))]
    cut = scans.Ranges(own, named, ["__place", "__long", "__back", "__id"], SPANS_AT_ONCE)
    rows = cut.rows.withColumnRenamed(cut.part, "__part")
    # a key's ranges follow one another; all keys but those that are in several ranges are left out here, so there are two rows for each range at most
    several = Window.partitionBy(*named)
    parts = rows.groupBy(*named, "__part").agg(F.min("__start").alias("__first")).withColumn("__of", F.count("*").over(several)).where("__of > 1")
    parts = tables.table(parts.withColumn("__first", F.min("__first").over(several.orderBy(F.desc("__part")))).drop("__of"))
    after = parts.withColumn("__then", F.lead("__first").over(several.orderBy("__part"))).where("__then is not null").select(*named, "__part", "__then")
    reach = tables.matching(rows, F.broadcast(after), [*named, "__part"]).where("__end > __then")
    later = parts.select(*named, F.col("__part").alias("__to"), "__first")
    sent = tables.table(tables.matching(reach, F.broadcast(later), named).where("__to > __part and __end > __first").select(*named, F.col("__to").alias("__part"), "__start", "__end", "__id"))
    many = sent.groupBy(*named, "__part").agg(F.ceil(F.count("*") / SPANS_AT_ONCE).cast("int").alias("__of"))
    at = F.coalesce(F.col("__of"), F.lit(1))
    copied = tables.matching(rows, F.broadcast(many), [*named, "__part"], "left").withColumn("__tile", F.explode(F.sequence(F.lit(0), at - 1))).withColumn("__sent", F.lit(False))
    dealt = tables.matching(sent, F.broadcast(many), [*named, "__part"]).withColumn("__tile", F.pmod(F.xxhash64("__start", "__end", "__id"), at).cast("int")).withColumn("__sent", F.lit(True))
    columns = [*named, "__part", "__tile", "__sent", "__start", "__end", "__id"]
    both = copied.select(*columns).unionByName(dealt.select(*columns)).repartition(2 * cut.ranges, *named, "__part", "__tile")
    schema = T.StructType([*[rows.schema[k] for k in named], *[T.StructField(n, T.StringType()) for n in ("relation", "pairs", "a", "b")]])

    def run(t: pa.Table) -> pa.Table:
        sent, line = t["__sent"].to_numpy(), np.stack([t[c].to_numpy() for c in ("__start", "__end", "__id")])
        own, tally = line[:, ~sent], Tally()
        own = own[:, np.lexsort((own[2], -own[1], own[1] > own[0], own[:2].min(0)))]
        if not t["__tile"][0].as_py():
            tally.within(own)
        tally.between(line[:, sent], own)
        found = [(k, *map(str, v)) for k, v in tally.sums.items()]
        head = [pa.repeat(t[k][0], len(found)) for k in named]
        return pa.Table.from_arrays([*head, *[pa.array([f[i] for f in found], pa.string()) for i in range(4)]], names=schema.names)

    sums = both.groupBy(*named, "__part", "__tile").applyInArrow(run, schema).groupBy(*named, "relation").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("pairs", "a", "b")])
    return sums.select(*[F.col(k).alias(c) for k, c in zip(named, keys, strict=True)], "relation", F.col("pairs").cast("long").alias("pairs"), "a", "b")


def malformed(spans: DataFrame, keys: list[str], chars: str, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, why) of spans that can't be spliced: empty, outside their text (chars: its length), or begun before the one before has ended."""
    line = Window.partitionBy(*keys).orderBy(start, end)
    why = F.when(F.col(start) >= F.col(end), "empty").when((F.col(start) < 0) | (F.col(end) > F.col(chars)), "outside").when(F.col(start) < F.lag(end).over(line), "overlapping")
    return spans.withColumn("why", why).where("why is not null").select(*keys, start, end, "why")
