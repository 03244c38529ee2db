"""Detection of identifiers in a text column.

One pass of Arrow batches, no shuffle: fold, match, validate, boost, resolve.  Rows that cannot hold a finding are told apart a batch at
a time, by linear-time patterns over the Arrow buffers (several times faster than the same test in the JVM); only the others become Python strings.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folding import Folded
from ..functions.identifiers import VALIDATORS
from ..sources import catalogs
from .resolution import checksummed, settle
from .spans import ARROW_SPANS, SPAN_TYPE, SPANS_TYPE, Span

#: Holds of every text with a finding of the built-in catalog: an at sign or two numeric characters, before folding too.
CANDIDATE = r"[@﹫＠]|\p{N}[^\p{N}]*\p{N}|[㈀-㏿\x{1F100}-\x{1F2FF}]"
#: Some character that folding may turn into a letter, digit or separator, or that isn't known not to be one; and, in texts without
#: such a character, what every text with a finding holds (see the gates of the rules).
FOLDABLE = r"[^\x00-\x7F¡-§©«-®°±µ-·»¿-ÿŒœ‘’“”„€]"
PLAIN_CANDIDATE = r"@|[0-9](?:[ ./-]?[ABab]?[ ./-]?[0-9]){8}|[A-Za-z]{2}[0-9]{2}[ -]?[A-Za-z0-9]{4}"
#: Characters that a word of context may take, and the most that a boost gives.
_REACH = 64
_CAP = 0.99
_WORD = re.compile(r"\w+")
_BREAK = re.compile("[ .-]")

#: Spans of further recognizers in a text, such as a named-entity model; runs in the Python worker.
Recognizer = Callable[[str], Iterable[Span]]


class Context:
    """The words around a place of a text; they are looked up once for a text, when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def places(self) -> tuple[list[int], list[int]]:
        found = [m.span() for m in _WORD.finditer(self.text)]
        return [a for a, _ in found], [b for _, b in found]

    def sides(self, start: int, end: int, count: int) -> tuple[str, str]:
        """The last count words before start and the first after end, each wholly within its reach."""
        begins, ends = self.places
        here, beyond = bisect_left(begins, start), bisect_right(ends, end)
        left = (self.text[a : min(b, start)] for a, b in zip(begins[max(0, here - count) : here], ends[max(0, here - count) : here], strict=True) if a >= start - count * _REACH)
        right = (self.text[max(a, end) : b] for a, b in zip(begins[beyond : beyond + count], ends[beyond : beyond + count], strict=True) if b <= end + count * _REACH)
        return catalogs.words(" ".join(left)), catalogs.words(" ".join(right))

    def boosts(self, boost: catalogs.Boost, start: int, end: int) -> bool:
        return any(map(boost.triggers.search, self.sides(start, end, boost.window)))


def _shorter(candidate: str) -> Iterator[str]:
    """The candidate without its last words, one more each time, as long as what goes has a letter."""
    end = len(candidate)
    for cut in [m.start() for m in _BREAK.finditer(candidate, 1)][::-1]:
        if not any(map(str.isalpha, candidate[cut + 1 : end])):
            return
        yield candidate[:cut]
        end = cut


def _accepted(rule: catalogs.Rule, candidate: str) -> str | None:
    """What of a candidate the rule's validator accepts: all of it, or what a greedy tail leaves."""
    if rule.validator is None:
        return candidate
    valid = VALIDATORS[rule.validator]
    return candidate if valid(candidate) else next((x for x in _shorter(candidate) if rule.pattern.fullmatch(x) and valid(x)), None)


class Finder:
    """Finds spans in one text; built once in a worker."""

    def __init__(self, rules: tuple[catalogs.Rule, ...] | None = None, recognizers: tuple[Recognizer, ...] = (), specificity: dict[str, int] | None = None, untouchable: Callable[[Span], bool] = checksummed):
        self.rules = catalogs.built_in() if rules is None else rules
        self.recognizers, self.untouchable = recognizers, untouchable
        self.specificity = {r.entity_type: r.specificity for r in self.rules} | (specificity or {})

    def _confidence(self, rule: catalogs.Rule, context: Context, start: int, end: int) -> tuple[float, bool]:
        """(confidence, boosted) of a match; a boost never lowers it and never makes it certain."""
        sure = rule.confidence
        if rule.boost is None or sure >= 1 or not context.boosts(rule.boost, start, end):
            return sure, False
        return max(sure, min(_CAP, round(sure + rule.boost.value, 9))), True

    def raw(self, text: str) -> list[Span]:
        """All findings of the rules, overlaps included."""
        folded = Folded(text)
        context, open_ = Context(folded.text), {}
        for gate in {r.gate for r in self.rules if r.gate is not None}:
            open_[gate] = gate.search(folded.text) is not None
        out = []
        for rule in self.rules:
            for m in rule.pattern.finditer(folded.text) if open_.get(rule.gate, True) else ():
                if (value := _accepted(rule, m[0])) is not None:
                    start, end = m.start(), m.start() + len(value)
                    sure, boosted = self._confidence(rule, context, start, end)
                    if sure >= rule.threshold:
                        out.append(Span(rule.entity_type, *folded.span(start, end), sure, f"catalog:{rule.id}", rule.tier, boosted))
        return out

    def __call__(self, text: str | None) -> list[Span]:
        """Resolved findings."""
        if not text:
            return []
        spans = self.raw(text)
        for recognizer in self.recognizers:
            spans += recognizer(text)
        return settle(spans, self.specificity, self.untouchable) if spans else []


def candidates(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Which texts can hold a finding of the built-in catalog; nulls can't."""

    def has(array: pa.Array, pattern: str) -> np.ndarray:
        return pc.fill_null(pc.match_substring_regex(array, pattern), False).to_numpy(zero_copy_only=False)

    out = has(texts, PLAIN_CANDIDATE)
    rest = np.flatnonzero(~out)
    rest = rest[has(texts.take(pa.array(rest)), FOLDABLE)]
    out[rest] = has(texts.take(pa.array(rest)), CANDIDATE)
    return out


def version(catalog: str | None = None) -> str:
    """32 hex digits that change with the rules, so that results of other rules can be told apart."""
    h = hashlib.sha256()
    for part in [repr(catalogs.IDENTIFIERS) if catalog is None else catalog, CANDIDATE, FOLDABLE, PLAIN_CANDIDATE]:
        h.update(len(part).to_bytes(8, "big") + part.encode())
    return h.hexdigest()[:32]


def detect(df: DataFrame, text: str = "text", into: str = "spans", catalog: str | None = None, recognizers: tuple[Recognizer, ...] = (), specificity: dict[str, int] | None = None, untouchable: Callable[[Span], bool] = checksummed, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, unless named) and an array of resolved spans.

    catalog: YAML text instead of the built-in rules; then every text is searched.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != into]
    return _searched(df, text, into, keep, SPANS_TYPE, ARROW_SPANS, lambda t, spans: [s._asdict() for s in spans], catalog, recognizers, specificity, untouchable)


def _searched(df: DataFrame, text: str, into: str, keep: list[str], kind: T.DataType, arrow: pa.DataType, shown: Callable[[str, list[Span]], list[dict]], catalog: str | None, recognizers: tuple[Recognizer, ...], specificity: dict[str, int] | None, untouchable: Callable[[Span], bool]) -> DataFrame:
    """The kept columns and what shown makes of each text's spans."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(into, kind)])
    read = keep if text in keep else [*keep, text]
    all_ = catalog is not None or bool(recognizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(None if catalog is None else catalogs.from_yaml(catalog), recognizers, specificity, untouchable)
        for b in batches:
            texts = b.column(read.index(text))
            found: list[list[dict]] = [[]] * b.num_rows
            for i in range(b.num_rows) if all_ else np.flatnonzero(candidates(texts)).tolist():
                if t := texts[i].as_py():  # one text at a time
                    found[i] = shown(t, find(t))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, arrow)], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, schema)


_VALUED = T.ArrayType(T.StructType([*SPAN_TYPE.fields, T.StructField("value", T.StringType())]))
_ARROW_VALUED = pa.list_(pa.struct([*ARROW_SPANS.value_type, ("value", pa.string())]))


def findings(df: DataFrame, keys: list[str], text: str = "text", catalog: str | None = None, recognizers: tuple[Recognizer, ...] = (), specificity: dict[str, int] | None = None, untouchable: Callable[[Span], bool] = checksummed) -> DataFrame:
    """One row for each finding: keys, the span's fields and its value.  Texts don't come back from the search."""

    def shown(t: str, spans: list[Span]) -> list[dict]:
        return [{**s._asdict(), "value": t[s.start : s.end]} for s in spans]

    rows = _searched(df, text, "__spans", list(keys), _VALUED, _ARROW_VALUED, shown, catalog, recognizers, specificity, untouchable)
    return rows.select(*keys, F.explode("__spans").alias("s")).select(*keys, "s.*")


def displayed(value: str) -> F.Column:
    """A value fit for a report: an ellipsis, or its first four and last two characters around one if it has eight or more."""
    v = F.col(value)
    return F.when(F.length(v) < 8, F.lit("…")).otherwise(F.concat(F.substring(v, 1, 4), F.lit("…"), F.expr(f"right({value}, 2)")))


#: The layers, the first of which always runs.
LAYERS = ("deterministic", "ner")


def layers(requested: list[str] | None, available: tuple[bool, str | None]) -> tuple[str, ...]:
    """The layers that run: those asked for, or all there are.  available: whether the named-entity layer is, and why not.

    A list that is empty, repeats a layer or leaves out the first is refused (ValueError), one that asks for a layer that isn't there too (RuntimeError).
    """
    there = LAYERS if available[0] else LAYERS[:1]
    if requested is None:
        return there
    if not requested or len(set(requested)) < len(requested) or LAYERS[0] not in requested or not set(requested) <= set(LAYERS):
        raise ValueError(f"layers are distinct, of {', '.join(LAYERS)}, and {LAYERS[0]} is one of them")
    if missing := [x for x in requested if x not in there]:
        raise RuntimeError(f"layers not available: {', '.join(missing)} ({available[1] or 'not configured'})")
    return tuple(requested)


def answered(df: DataFrame, requested: list[str] | None = None, recognizers: tuple[Recognizer, ...] = (), text: str = "text", **options) -> DataFrame:
    """df with spans, layers_run and version, as an answer tells them; complete: whether every layer ran."""
    run = layers(requested, (bool(recognizers), None if recognizers else "no weights"))
    found = detect(df, text, recognizers=recognizers if "ner" in run else (), **options)
    return found.withColumns({"layers_run": F.array(*map(F.lit, run)), "version": F.lit(version(options.get("catalog"))), "complete": F.lit(run == LAYERS)})


def found_by(recognizer: str = "recognizer", confidence: str = "confidence") -> Column:
    """How a span was found: checksum, pattern, ner or other."""
    by = F.col(recognizer)
    return F.when(by.startswith("catalog:"), F.when(F.col(confidence) >= 1, "checksum").otherwise("pattern")).when((by == "ner") | by.startswith("ner:"), "ner").otherwise("other")
