"""Sessions: one mapping over many turns.

A session's turns depend on each other: values known from earlier turns are hidden in later ones even where no
rule finds them.  ``turn`` does one after another, for streams and chat bodies; ``mask_sessions`` solves a table of turns in parallel.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Container, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice, pairwise
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from ..sources.catalogs import ENTITY_TYPES, FALLBACK_TYPE
from . import pseudonyms, scans
from .detection import Finder, detect
from .pseudonyms import TOKEN

#: Values that a session keeps, idle seconds, sessions, matches of known values in a text.
MOST_VALUES, IDLE_SECONDS, MOST_SESSIONS, MATCH_BUDGET = 1000, 1800, 1000, 1 << 20
_TOKEN = re.compile(TOKEN)
_WORD, _WORDS = re.compile(r"\w"), re.compile(r"\w+")


class Refused(ValueError):
    """error_class is the argument."""


class Mapping:
    """Values and their placeholders; what a turn adds is kept only if the turn succeeds."""

    def __init__(self, most: int = MOST_VALUES):
        self.most, self.next = most, 1
        self.tokens: dict[str, str] = {}  # by value
        self.values: dict[str, str] = {}  # by token
        self.reserved: set[str] = set()
        self.lengths: dict[int, int] = {}  # how many values have this length
        self._undo: list[tuple[Any, Any]] | None = None  # what a turn has added so far

    def dump(self) -> str:
        return json.dumps([self.most, self.next, self.tokens, sorted(self.reserved)])

    @classmethod
    def load(cls, text: str) -> Mapping:
        most, next_, tokens, reserved = json.loads(text)
        m = cls(most)
        m.next, m.reserved = next_, set(reserved)
        for value, token in tokens.items():
            m._add(value, token)
        return m

    def _add(self, value: str, token: str) -> None:
        self.tokens[value], self.values[token] = token, value
        self.lengths[len(value)] = self.lengths.get(len(value), 0) + 1

    def _drop(self, value: str) -> None:
        del self.values[self.tokens.pop(value)]
        self.lengths[len(value)] -= 1
        if not self.lengths[len(value)]:
            del self.lengths[len(value)]

    @contextmanager
    def attempt(self) -> Iterator[None]:
        """A turn's work: if it fails, what it added is taken back, so a turn costs what it adds and not what the mapping holds."""
        before, self._undo = self.next, []
        try:
            yield
            if len(self.tokens) > self.most:  # the earliest values are kept; the counter has passed the others
                for value in list(islice(reversed(self.tokens), len(self.tokens) - self.most)):
                    self._drop(value)
        except BaseException:
            self.next = before
            for value, literal in reversed(self._undo):
                if literal is None:
                    self._drop(value)
                else:
                    self.reserved.discard(literal)
            raise
        finally:
            self._undo = None

    def reserve_all(self, texts: Iterable[str]) -> None:
        for text in texts:
            if "[" in text:
                self.reserve(text)

    def reserve(self, text: str) -> None:
        """Literals that the caller wrote keep their tokens; one that stands for a value already is refused."""
        for token in _TOKEN.findall(text):
            if token in self.values:
                raise Refused("mapping_literal_already_issued")
            if token not in self.reserved:
                self.reserved.add(token)
                if self._undo is not None:
                    self._undo.append((None, token))

    def token(self, value: str, entity_type: str) -> str:
        if value not in self.tokens:
            kind = entity_type if entity_type in ENTITY_TYPES else FALLBACK_TYPE
            while f"[{kind}_{self.next}]" in self.reserved:
                self.next += 1
            self._add(value, f"[{kind}_{self.next}]")
            self.next += 1
            if self._undo is not None:
                self._undo.append((value, None))
        return self.tokens[value]

    def known(self, text: str) -> Iterator[tuple[int, int]]:
        """All whole-word occurrences of values, also overlapping ones, the longest values first."""
        if len(text) * len(self.lengths) > MATCH_BUDGET:
            return whole_words(text, occurrences(automaton(self.tokens), text))
        return iter(known_words(text, self.tokens, self.lengths))


def known_words(text: str, values: Container[str], lengths: Iterable[int]) -> list[tuple[int, int]]:
    """What whole_words gives for all occurrences of values with these lengths, in the same order; each place is looked up, so the work doesn't depend on how many values there are."""
    edge = bytearray(b"\1") * (len(text) + 1)
    for m in _WORDS.finditer(text) if lengths else ():
        edge[m.start() + 1 : m.end()] = bytes(m.end() - m.start() - 1)
    places = [i for i, free in enumerate(edge) if free]
    found = [(-n, text[a : a + n], a) for n in lengths if n for a in places if a + n <= len(text) and edge[a + n] and text[a : a + n] in values]
    return [(a, a - size) for size, _, a in sorted(found)]


def automaton(values: Iterable[str]) -> ahocorasick.Automaton | None:
    """What finds all of the values in one pass over a text; None if there are none."""
    out = ahocorasick.Automaton()
    for v in values:
        if v:
            out.add_word(v, v)
    if not len(out):
        return None
    out.make_automaton()
    return out


def occurrences(of: ahocorasick.Automaton | None, text: str, counts: Callable[[str], bool] = lambda v: True) -> list[tuple[int, int]]:
    """(start, end) of all occurrences of values that count, the longest values first, then by value and place."""
    found = [(-len(v), v, end + 1 - len(v)) for end, v in of.iter(text) if counts(v)] if of else []
    if len(found) > MATCH_BUDGET:
        raise Refused("mapping_known_values_overlap")
    return [(a, a - size) for size, _, a in sorted(found)]


def whole_words(text: str, spans: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans that neither begin nor end within a word."""

    def inside(left: int) -> bool:
        return 0 < left < len(text) and bool(_WORD.match(text[left - 1]) and _WORD.match(text[left]))

    return ((a, b) for a, b in spans if not inside(a) and not inside(b))


def placed(text: str, spans: Iterable[tuple[int, int, str]], known: Iterable[tuple[int, int]]) -> list[tuple[int, int, str | None]]:
    """Spans to hide, in order: a known value displaces the found spans that it contains, and yields to others it overlaps."""
    out: list[tuple[int, int, str | None]] = sorted(spans)
    if any(not 0 <= a < b <= len(text) for a, b, _ in out) or any(x[1] > y[0] for x, y in pairwise(out)):
        raise Refused("mapping_bad_span")
    ends, starts = [b for _, b, _ in out], [a for a, _, _ in out]  # disjoint spans in order, so both ascend
    for a, b in known:
        i, j = bisect_right(ends, a), bisect_left(starts, b)  # those that share a character
        if i == j or a <= starts[i] and ends[j - 1] <= b:
            out[i:j], starts[i:j], ends[i:j] = [(a, b, None)], [a], [b]
    return out


def mask(mapping: Mapping, text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """text with spans and known values replaced; the mapping grows."""
    out, at = [], 0
    for a, b, kind in placed(text, spans, list(mapping.known(text))):
        value = text[a:b]
        out += [text[at:a], mapping.tokens[value] if kind is None else mapping.token(value, kind)]
        at = b
    return "".join([*out, text[at:]])


def turn(mapping: Mapping, text: str | None, find: Finder) -> tuple[Mapping, str | None, str | None]:
    """(mapping after the turn, masked text, error_class); a refused turn leaves the mapping as it was."""
    if text is None:
        return mapping, None, None
    try:
        with mapping.attempt():
            mapping.reserve(text)
            return mapping, mask(mapping, text, [(s.start, s.end, s.entity_type) for s in find(text)]), None
    except Refused as e:
        return mapping, None, str(e)


#: Turns of one session that meet its values in one task.
TURNS_AT_ONCE = 2048
#: Powers of two: counters of a row of the sketch of words, and places of the set of words that lead to values.  Both are broadcast (4 MB each).
SKETCH, LEADING = 18, 25
_PIECE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
_ARROW_PIECES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))


def _piece(text: str, at: tuple[int, int, str | None]) -> dict:
    return {"start": at[0], "end": at[1], "kind": at[2], "value": text[at[0] : at[1]]}


def _key(at: dict) -> tuple:
    """A place in a session's order, nulls first."""
    return tuple((v is not None, v if v is not None else 0) for v in at.values())


def _met_all(turns: DataFrame, issued: DataFrame, keys: list[str], blocks: DataFrame) -> DataFrame:
    """(__row, __pieces, __error) of every turn, given the values that its session keeps: what is to be hidden (kind: null for a value that is known), or why it is refused.

    Every turn meets all values of its session by an automaton.  For texts so long that the occurrences of values in them have to be counted against the limit.
    """
    none = {c: F.lit(None).cast(turns.schema[c].dataType) for c in ("__row", "__at", "__text", "__spans", "__tokens")}
    many = tables.matching(turns, blocks, keys, "left").select(*turns.columns, F.pmod(F.xxhash64("__row"), F.coalesce("__blocks", F.lit(1))).cast("int").alias("__block"))
    spread = tables.matching(issued, blocks, keys, "left").select(*issued.columns, F.explode(F.sequence(F.lit(0), (F.coalesce("__blocks", F.lit(1)) - 1).cast("int"))).alias("__block"))
    both = many.withColumns({"value": F.lit(None).cast("string"), "token": F.lit(None).cast("string"), "__since": none["__at"]}).unionByName(spread.withColumns(none))
    dealt = both.repartition(*[F.col(k) for k in keys], "__block").sortWithinPartitions(*keys, "__block", F.col("__row").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, since, tokens, finds = None, {}, {}, None
        for b in batches:
            rows, columns = [], [b.column(i).to_pylist() for i in range(b.num_columns)]
            for *own, row, at, text, spans, wrote, value, token, when in zip(*columns, strict=True):
                if own != group:
                    group, since, tokens, finds = own, {}, {}, None
                if row is None:
                    since[value] = tokens[token] = _key(when)
                    continue
                if text is None:
                    continue
                finds, now = finds or automaton(since), _key(at)
                try:
                    if any(tokens.get(t, now) < now for t in wrote or ()):
                        raise Refused("mapping_literal_already_issued")
                    known = whole_words(text, occurrences(finds, text, lambda v, now=now: since[v] < now))
                    pieces = placed(text, [(s["start"], s["end"], s["entity_type"]) for s in spans or ()], known)
                    rows.append((row, [_piece(text, p) for p in pieces], None))
                except Refused as e:
                    rows.append((row, [], str(e)))
            c = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], _ARROW_PIECES), pa.array(c[2], pa.string())], names=["__row", "__pieces", "__error"])

    schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField("__pieces", _PIECE), T.StructField("__error", T.StringType())])
    return dealt.select(*keys, "__block", "__row", "__at", "__text", "__spans", "__tokens", "value", "token", "__since").mapInArrow(run, schema)


def _spread(words: Iterable[str]) -> np.ndarray:
    """Two 32-bit numbers of each word, as rows."""
    own = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64)
    return np.stack([own, own * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)])


def _places(hashes: np.ndarray) -> np.ndarray:
    """Where the sketch counts words, in each of its two rows."""
    return (hashes >> np.uint64(32 - SKETCH)).astype(np.int64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes[1] >> np.uint64(32 - LEADING)).astype(np.int64)


def _sketched(texts: DataFrame, text: str) -> np.ndarray:
    """How often words occur in texts, once for each text that has them: a count-min sketch, so a word's smaller counter is never below its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << SKETCH), np.int64)
        for b in batches:
            at = _places(_spread(w for t in b.column(0).to_pylist() for w in set(_WORDS.findall(t))))
            for row in range(2):
                counts[row] += np.bincount(at[row], minlength=1 << SKETCH)
        flat = counts.ravel()
        used = flat.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(flat[used])], names=["place", "n"])

    sums = tables.collected(texts.select(text).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")))
    out = np.zeros(2 << SKETCH, np.int64)
    out[sums["place"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(2, -1)


def _leads(issued: DataFrame, keys: list[str], sketch: Broadcast) -> DataFrame:
    """(keys, value, __since, word, __bit) of each value: its rarest word by the sketch (null if it has none), and the word's place in the set of such words."""
    names = [*keys, "value", "__since"]
    schema = T.StructType([*[issued.schema[c] for c in names], T.StructField("word", T.StringType()), T.StructField("__bit", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(set(_WORDS.findall(v))) for v in b.column(len(keys)).to_pylist()]
            hashes = _spread(w for words in own for w in words)
            often, bits, at = np.minimum(*(row[p] for row, p in zip(sketch.value, _places(hashes), strict=True))), _bits(hashes), 0
            rarest: list[tuple[str | None, int | None]] = []
            for words in own:
                i = int(often[at : at + len(words)].argmin()) if words else 0
                rarest.append((words[i], int(bits[at + i])) if words else (None, None))
                at += len(words)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([w for w, _ in rarest], pa.string()), pa.array([x for _, x in rarest], pa.int64())], names=schema.names)

    return issued.select(*names).mapInArrow(run, schema)


def _words(texts: DataFrame, keys: list[str], leading: Broadcast) -> DataFrame:
    """(keys, __row, __at, word) of the distinct words of each text that may lead to a value; a word is what no known value begins or ends within."""
    names = [*keys, "__row", "__at"]
    schema = T.StructType([*[texts.schema[c] for c in names], T.StructField("__words", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(dict.fromkeys(_WORDS.findall(t))) for t in b.column(len(names)).to_pylist()]
            at = _bits(_spread(w for words in found for w in words))
            led = iter((leading.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([[w for w in words if next(led)] for words in found], pa.list_(pa.string()))], names=schema.names)

    return texts.select(*names, "__text").mapInArrow(run, schema).select(*names, F.explode("__words").alias("word"))


def _met(turns: DataFrame, issued: DataFrame, keys: list[str], sketch: Broadcast) -> DataFrame:
    """(keys, __row, __at, __tokens, __pieces, __error) of every turn, given the values that its session keeps: what is to be hidden (kind: null for a value that is known), or why it is refused.

    turns: keys, __row, __at, __text, __spans, __tokens; issued: keys, value, token, __since (the turn that issued it).  A value is known to the turns after the
    one that issued it.  Where a value stands as whole words, all of its words are words of the text, so a turn looks up the values of which it has the rarest
    word; a value without words is looked up by all turns.  The work follows the values that turns share a rare word with, not turns times values.  Which word
    of a value is rare is read from a sketch, and only words that may lead to a value leave their text, so neither words nor values are shuffled to be counted.
    """
    context = turns.sparkSession.sparkContext
    lengths = issued.groupBy(*keys).agg(F.countDistinct(F.length("value")).alias("__lengths"))
    sized = tables.matching(turns.where("__text is not null"), lengths, keys, "left").withColumn("__long", F.coalesce(F.length("__text").cast("long") * F.col("__lengths") > MATCH_BUDGET, F.lit(False))).drop("__lengths")
    short, long_ = sized.where("not __long").drop("__long"), sized.where("__long").drop("__long")
    leads = _leads(issued, keys, sketch)
    used = tables.collected(leads.groupBy(F.shiftright("__bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__bit & 63 as int))")).alias("bits"))).to_pydict()
    bare, leading = None in used["at"], np.zeros(1 << LEADING - 6, np.int64)
    for at, bits in zip(used["at"], used["bits"], strict=True):
        if at is not None:
            leading[at] = bits
    words = _words(short, keys, context.broadcast(leading.view(np.uint64)))
    hits = tables.matching(words, leads.where("word is not null"), [*keys, "word"]).where("__since < __at").select("__row", "value")
    if bare:
        hits = hits.unionByName(tables.matching(short.select(*keys, "__row", "__at"), leads.where("word is null").drop("word", "__bit"), keys).where("__since < __at").select("__row", "value"))
    wrote = short.where(F.size("__tokens") > 0).select(*keys, "__row", "__at", F.explode("__tokens").alias("token"))
    taken = tables.matching(wrote, issued, [*keys, "token"]).where("__since < __at").select("__row", F.lit(None).cast("string").alias("value"))
    both = hits.withColumn("__taken", F.lit(False)).unionByName(taken.withColumn("__taken", F.lit(True)))
    known = tables.table(both.groupBy("__row").agg(F.collect_set("value").alias("__known"), F.max("__taken").alias("__taken")))
    names = [*keys, "__row", "__at", "__tokens"]
    rows = short.join(known, "__row", "left").select(*names, "__text", "__spans", "__known", "__taken")
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("__pieces", _PIECE), T.StructField("__error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, errors = [], []
            for text, spans, values, refused in zip(*[c.to_pylist() for c in b.columns[len(names) :]], strict=True):
                out, error = [], "mapping_literal_already_issued" if refused else None
                if not refused:
                    try:
                        values = set(values or ())
                        out = [_piece(text, p) for p in placed(text, [(s["start"], s["end"], s["entity_type"]) for s in spans or ()], known_words(text, values, {len(v) for v in values}))]
                    except Refused as e:
                        error = str(e)
                pieces.append(out)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(pieces, _ARROW_PIECES), pa.array(errors, pa.string())], names=schema.names)

    met = rows.mapInArrow(run, schema)
    if long_.isEmpty():
        return met
    blocks = long_.groupBy(*keys).agg(F.ceil(F.count("*") / TURNS_AT_ONCE).cast("int").alias("__blocks")).where("__blocks > 1")
    return met.unionByName(long_.select(*names).join(_met_all(long_, issued, keys, blocks), "__row"))


def _issued(met: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, value, first, placeholder, __kept) of everything that turns issue: kept values once, by the first of them; others anew in each turn."""
    met = met.where("__error is null")
    found = met.select(*keys, "__at", F.explode("__pieces").alias("p")).where("p.kind is not null")
    found = found.select(*keys, "__at", "p.value", pseudonyms.known_type(F.col("p.kind")).alias("entity_type"), F.struct(F.col("__at").alias("at"), F.col("p.start").alias("start")).alias("first"))
    firsts = found.groupBy(*keys, "value").agg(F.min_by("entity_type", "first").alias("entity_type"), F.min("first").alias("first"))
    cut = scans.Ranges(firsts, keys, ["first"])
    ranked = tables.table(cut.running(cut.rows, "__rank", F.sum, F.lit(1)).drop(cut.part).withColumn("__kept", F.col("__rank") <= most))
    events, declined = ranked, ranked.where("not __kept").select(*keys, "value")
    if not declined.isEmpty():
        again = tables.matching(found, declined, [*keys, "value"], "left_semi").groupBy(*keys, "value", "__at").agg(F.min_by("entity_type", "first").alias("entity_type"), F.min("first").alias("first"))
        events = ranked.where("__kept").drop("__rank").unionByName(again.drop("__at").withColumn("__kept", F.lit(False)))
    wrote = met.where(F.size("__tokens") > 0).select(*keys, "__at", F.explode("__tokens").alias("token")).groupBy(*keys, "token").agg(F.min("__at").alias("since"))
    numbered = pseudonyms.number(events, keys, None if wrote.isEmpty() else wrote)
    return numbered.select(*keys, "value", "first", "placeholder", "__kept")


def mask_sessions(df: DataFrame, session: list[str], order: list[str], text: str = "text", most: int = MOST_VALUES) -> DataFrame:
    """session, order, masked text, status and error_class of every turn (nulls first in the order).

    What a turn hides depends on the values that the turns before it issued.  That is solved for all turns of all sessions at once: assumed that every found
    span issues its value, all turns meet (by their words) the values that were issued before them; what they then issue is assumed next, until nothing changes.
    The first turns of a session are right after the first round, those that depend on them after the next, and so on; only known values that hold found
    spans, and refused turns, need more than one.  So the turns of one session are worked on in parallel.  Equal places in the order are told apart by row.
    """
    keys = [f"__k{i}" for i in range(len(session))]
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    own = F.col(f"`{text}`")
    found = tables.table(detect(rows, text, "__spans").withColumn("__tokens", pseudonyms.tokens(own)))
    at = F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(order)], F.col("__row").alias("row"))
    turns = found.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(session, keys, strict=True)], "__row", at.alias("__at"), own.alias("__text"), "__spans", "__tokens")
    taken = F.transform("__spans", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["entity_type"].alias("kind"), F.substring("__text", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")).alias("value")))
    met = turns.where("__text is not null").select(*keys, "__row", "__at", "__tokens", taken.alias("__pieces"), F.lit(None).cast("string").alias("__error"))
    spark, state, sketch, met_at = df.sparkSession, None, None, None
    while True:
        issued_at = tables.alone(spark, lambda met=met: _issued(met, keys, most))
        issued = spark.read.parquet(issued_at)
        digest = issued.agg(F.count("*"), F.sum(F.xxhash64(*issued.columns).cast("decimal(38,0)"))).first()
        if digest == state or not digest[0]:
            break
        state = digest
        kept = issued.where("__kept").select(*keys, "value", F.col("placeholder").alias("token"), F.col("first.at").alias("__since"))
        sketch = sketch or spark.sparkContext.broadcast(_sketched(turns.where("__text is not null"), "__text"))
        tables.delete(spark, met_at)
        met_at = tables.alone(spark, lambda kept=kept: _met(turns, kept, keys, sketch))
        tables.delete(spark, issued_at)
        met = spark.read.parquet(met_at)
    pieces = met.where("__error is null").select(*keys, "__row", F.col("__at").alias("at"), F.explode("__pieces").alias("p")).select(*keys, "__row", "at", "p.start", "p.end", "p.value")
    own_issue = issued.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("value").alias("v"), F.when(~F.col("__kept"), F.col("first.at")).alias("only"), "placeholder", "__kept")
    same = (F.col("value") == F.col("v")) & (F.col("__kept") | (F.col("only") == F.col("at")))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    named = pieces.join(own_issue, same).groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "placeholder"))).alias("__named")).withColumn("__error", F.lit(None).cast("string"))
    named = tables.table(named.unionByName(met.where("__error is not null").select("__row", "__error"), allowMissingColumns=True))
    tables.delete(spark, met_at, issued_at)
    out = found.join(named, "__row", "left")
    masked = F.when(F.col("__error").isNull(), F.when(F.col("__named").isNull(), own).otherwise(pseudonyms.splice(own, F.col("__named"))))
    names = list(dict.fromkeys([*session, *order]))
    return out.select(*[F.col(f"`{c}`") for c in names], masked.alias(text), F.when(F.col("__error").isNull(), "completed").otherwise("refused").alias("status"), F.col("__error").alias("error_class"))


#: What giving a session up costs, the cheapest first.  A held one is never given up.
EMPTY, WITH_VALUES, HELD = 0, 1, 2


def admit(live: DataFrame, arrivals: DataFrame, keys: list[str], now: Column, idle_seconds: int = IDLE_SECONDS, most: int = MOST_SESSIONS) -> tuple[DataFrame, DataFrame]:
    """(sessions after a batch of arrivals, the arrivals with status and error_class).

    live: keys, last_seen, tier (what it costs to give the session up); arrivals: keys.  Sessions idle for idle_seconds go unless they are held; an
    arrival of a live session refreshes it; new ones take the free places, then those of the cheapest sessions, the oldest first, and of
    equal ones by key.  Who finds no place is refused as saturated, the last by key first.  As many rows as there may be sessions are ordered in one task.
    """
    seen = arrivals.select(*keys).distinct()
    kept = live.where((F.col("tier") >= HELD) | (F.unix_timestamp(now) - F.unix_timestamp("last_seen") < idle_seconds))
    known = kept.join(seen.withColumn("__here", F.lit(True)), tables.same(kept, seen, keys), "left").select(*[kept[c] for c in live.columns], F.coalesce("__here", F.lit(False)).alias("__here"))
    new = seen.join(kept, tables.same(seen, kept, keys), "left_anti")
    order = Window.orderBy(*[F.col(c).asc_nulls_first() for c in keys])
    places = known.agg((F.lit(most) - F.count("*")).alias("__free"), F.coalesce(F.sum(((F.col("tier") < HELD) & ~F.col("__here")).cast("long")), F.lit(0)).alias("__open"))  # one row
    asked = new.withColumn("__n", F.row_number().over(order)).crossJoin(places)
    admitted = tables.table(asked.withColumn("__ok", F.col("__n") <= F.greatest("__free", F.lit(0)) + F.col("__open")))
    needed = admitted.where("__ok").agg(F.coalesce(F.max(F.col("__n") - F.greatest("__free", F.lit(0))), F.lit(0)).alias("__gone"))  # one row
    cheapest = Window.orderBy((F.col("__here") | (F.col("tier") >= HELD)).cast("int"), "tier", "last_seen", *[F.col(c).asc_nulls_first() for c in keys])
    ranked = known.withColumn("__cost", F.row_number().over(cheapest)).crossJoin(needed)
    left = ranked.where(F.col("__cost") > F.col("__gone")).select(*keys, F.when(F.col("__here"), now).otherwise(F.col("last_seen")).alias("last_seen"), "tier")
    fresh = admitted.where("__ok").select(*keys, now.alias("last_seen"), F.lit(EMPTY).alias("tier"))
    refused = admitted.where("not __ok").select(*keys, F.lit("session_saturated").alias("error_class"))
    answers = arrivals.join(refused, tables.same(arrivals, refused, keys), "left").select(*[arrivals[c] for c in arrivals.columns], F.when(F.col("error_class").isNull(), "completed").otherwise("refused").alias("status"), "error_class")
    return left.unionByName(fresh), answers
