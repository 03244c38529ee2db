"""Restoring placeholders in streamed answers, event by event.

An answer's texts come in pieces, many at once: a run is one text (of a choice, or of a content block) or one tool document.  Texts
are restored as far as no token may be cut; what is held back is added to the run's last event, so an event with text waits until the next
one comes, and events without text wait behind it.  A tool document is gathered whole, restored when its run ends, and given out in the event that
opened it.  An error gives out what is complete, never what is held back, and then one error event.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.places import Lexer
from ..operators import chat, jsontext, restoration
from ..operators.jsontext import Members, Number, Refused
from . import fragments
from .fragments import Fragments, Framer, Ordered, Oversized

#: Open runs, bytes that wait behind an event, and bytes of a tool document.
MOST_RUNS, MOST_QUEUED, MOST_DOCUMENT = 64, 64 << 10, 256 << 10
#: Fixed value: what ends a stream of the chat shape.
END_OF_STREAM = "[DONE]"


class Failed(ValueError):
    """error_class is the argument."""


class Event(NamedTuple):
    name: str | None
    data: str | None
    other: tuple[str, ...] = ()

    def render(self) -> str:
        lines = [f"event: {self.name}"] if self.name is not None else []
        lines += self.other
        lines += [f"data: {line}" for line in self.data.split("\n")] if self.data is not None else []
        return "".join(f"{line}\n" for line in [*lines, ""])


class Place(NamedTuple):
    """Where an event holds a piece of a run."""

    run: str
    pointer: str
    document: bool = False


class Ends(NamedTuple):
    """The runs that an event ends: all, or those whose name is or begins like one of these."""

    all: bool = False
    runs: tuple[str, ...] = ()
    under: tuple[str, ...] = ()

    def __contains__(self, run: str) -> bool:
        return self.all or run in self.runs or run.startswith(self.under or ("\0",))

    def __bool__(self) -> bool:
        return self.all or bool(self.runs or self.under)


ALL = Ends(all=True)


def _get(node: Any, *path: str) -> Any:
    for key in path:
        node = dict(node).get(key) if isinstance(node, Members) else None
    return node


def _list(value: Any) -> list:
    return value if isinstance(value, list) and not isinstance(value, Members) else []


def _number(value: Any, default: int) -> int:
    return int(value) if isinstance(value, Number) and value.isdigit() else default


def _piece(value: Any, run: str, pointer: str, document: bool = False) -> Iterator[Place]:
    if value is None:
        return
    if not isinstance(value, str) or isinstance(value, Number):
        raise Refused("shape_response")
    yield Place(run, pointer, document)


class ChatShape:
    """Choices with deltas."""

    def places(self, root: Any) -> Iterator[Place]:
        for at, choice in enumerate(_list(_get(root, "choices"))):
            carried = _get(choice, "logprobs")
            if carried is not None and not (isinstance(carried, Members) and all(k in ("content", "refusal") and v in (None, []) for k, v in carried)):
                raise Refused("shape_unsupported")
            if any(_get(choice, "delta", name) is not None for name in ("audio", "function_call")):
                raise Refused("shape_unsupported")
            run = f"choice/{_number(_get(choice, 'index'), at)}/"
            for name in ("content", "refusal"):
                yield from _piece(_get(choice, "delta", name), run + name, f"/choices/{at}/delta/{name}")
            calls = _get(choice, "delta", "tool_calls")
            if calls is not None and (not isinstance(calls, list) or isinstance(calls, Members)):
                raise Refused("shape_response")
            for i, call in enumerate(calls or []):
                yield from _piece(_get(call, "function", "arguments"), f"{run}tool/{_number(_get(call, 'index'), i)}", f"/choices/{at}/delta/tool_calls/{i}/function/arguments", True)

    def ends(self, root: Any) -> Ends:
        done = [f"choice/{_number(_get(c, 'index'), at)}/" for at, c in enumerate(_list(_get(root, "choices"))) if _get(c, "finish_reason") is not None]
        return Ends(under=tuple(done))

    def split(self, root: Any) -> list[Any]:
        """One event for each choice; what was used is told with the last."""
        choices = _list(_get(root, "choices"))
        if len(choices) < 2 or not all(isinstance(_get(c, "index"), Number) for c in choices):
            return []
        last = len(choices) - 1
        return [Members((k, [c] if k == "choices" else v) for k, v in root if k != "usage" or i == last) for i, c in enumerate(choices)]


class MessagesShape:
    """Content blocks."""

    _DELTAS = {"text_delta": ("text", False), "input_json_delta": ("partial_json", True)}

    def places(self, root: Any) -> Iterator[Place]:
        run, kind = f"block/{_number(_get(root, 'index'), 0)}", _get(root, "type")
        if kind == "content_block_delta":
            member, document = self._DELTAS.get(_get(root, "delta", "type"), (None, False))
            if member is None or _get(root, "delta", member) is None:
                raise Refused("shape_response")
            yield from _piece(_get(root, "delta", member), run, f"/delta/{member}", document)
        elif kind == "content_block_start":
            block = _get(root, "content_block", "type")
            if block not in ("text", "tool_use") or block == "text" and _get(root, "content_block", "text") is None:
                raise Refused("shape_response")
            if block == "text":
                yield from _piece(_get(root, "content_block", "text"), run, "/content_block/text")

    def ends(self, root: Any) -> Ends:
        kind = _get(root, "type")
        if kind == "content_block_stop":
            return Ends(runs=(f"block/{_number(_get(root, 'index'), 0)}",))
        return ALL if kind in ("message_stop", "error") else Ends()

    def split(self, root: Any) -> list[Any]:
        return []


#: Shapes by name; further ones may be added.
SHAPES: dict[str, Any] = {"chat": ChatShape(), "messages": MessagesShape()}


class Stream:
    """feed() and finish() put finished events into ready; after an error, abandon() gives what is left and the error event."""

    def __init__(self, shape: str, values: dict[str, str], literals: tuple[str, ...] = (), client_format: str | None = None):
        self.shape, self.client_format = shape, client_format
        self.look = restoration.Strict(values, literals)
        self.tokens = dict(values) | {t: t for t in literals}
        self.ready: list[Event] = []
        self.texts: dict[str, Fragments] = {}
        self.documents: dict[str, dict[str, Any]] = {}  # raw, pointer, group
        self.carriers: dict[str, Event] = {}  # by group; without their pieces
        self.groups = 0
        self.pending: tuple[Event, dict[str, str]] | None = None  # an event with text, and where each run is in it
        self.queued: list[Event] = []

    # --- state between batches ---

    def dump(self) -> dict[str, Any]:
        return {
            "texts": {k: [f.held, f.lexer.dump()] for k, f in self.texts.items()}, "documents": self.documents, "carriers": {k: list(e) for k, e in self.carriers.items()}, "groups": self.groups,
            "pending": self.pending and [list(self.pending[0]), self.pending[1]], "queued": [list(e) for e in self.queued],
        }

    def load(self, state: dict[str, Any]) -> Stream:
        self.texts = {k: Fragments(self.tokens, True, held, Lexer.load(lexer)) for k, (held, lexer) in state["texts"].items()}
        self.documents, self.groups = state["documents"], state["groups"]
        self.carriers = {k: _event(e) for k, e in state["carriers"].items()}
        self.pending = state["pending"] and (_event(state["pending"][0]), state["pending"][1])
        self.queued = [_event(e) for e in state["queued"]]
        return self

    # --- events ---

    def feed(self, event: Event) -> None:
        try:
            self._feed(event)
        except Refused as e:
            raise Failed(_class(str(e))) from None

    def finish(self) -> None:
        try:
            self._end(ALL)
        except Refused as e:
            raise Failed(_class(str(e))) from None

    def abandon(self, error: str) -> list[Event]:
        """What is complete, and the error."""
        out = self.ready + ([self.pending[0]] if self.pending else []) + self.queued
        self.ready, self.pending, self.queued, self.texts, self.documents = [], None, [], {}, {}
        return [*out, Event("error", json.dumps({"error": {"type": "restoration_failed", "message": error}}))]

    def _feed(self, event: Event) -> None:
        if not event.data:
            self._behind(event)
            return
        if event.data == END_OF_STREAM:
            self._end(ALL)
            self.ready.append(event)
            return
        try:
            root = jsontext.parse(event.data)
        except Refused as e:
            raise Failed("stream_malformed") from e
        shape = SHAPES[self.shape]
        places, ends = list(shape.places(root)), shape.ends(root)
        if not places:
            event = event._replace(data=jsontext.dump(self.look.value(root)))
            if ends:
                self._end(ends)
                self.ready.append(event)
            else:
                self._behind(event)
        elif any(p.document for p in places):
            parts = shape.split(root)
            if not parts and not all(p.document for p in places):
                raise Refused("shape_response")
            for part in parts:
                self._feed(event._replace(data=jsontext.dump(part)))
            if not parts:
                self._gather(event, root, places)
                if ends:
                    self._end(ends)
        else:
            self._speak(event, root, places, ends)

    def _scrubbed(self, root: Any, places: list[Place]) -> Any:
        """The event without the pieces of runs, restored."""
        bare = _copied(root)
        for p in places:
            chat.write(bare, p.pointer, "")
        return self.look.value(bare)

    def _opened(self, run: str) -> None:
        if run not in self.texts and run not in self.documents and len(self.texts) + len(self.documents) >= MOST_RUNS:
            raise Failed("stream_too_many_runs")

    def _gather(self, event: Event, root: Any, places: list[Place]) -> None:
        group, opened = str(self.groups), False
        for p in places:
            if p.run in self.texts:
                raise Refused("shape_response")
            self._opened(p.run)
            if p.run not in self.documents:
                self.documents[p.run], opened = {"raw": "", "pointer": p.pointer, "group": group}, True
            self.documents[p.run]["raw"] += chat.read(root, p.pointer)
            if len(self.documents[p.run]["raw"].encode()) > MOST_DOCUMENT:
                raise Failed("stream_tool_document_too_large")
        if opened:
            self.carriers[group] = event._replace(data=jsontext.dump(self._scrubbed(root, places)))
            self.groups += 1

    def _speak(self, event: Event, root: Any, places: list[Place], ends: Ends) -> None:
        out = self._scrubbed(root, places)
        for p in places:
            if p.run in self.documents:
                raise Refused("shape_response")
            self._opened(p.run)
            run = self.texts.setdefault(p.run, Fragments(self.tokens, True, "", Lexer(self.client_format)))
            chat.write(out, p.pointer, _pushed(run, chat.read(root, p.pointer)))
        if self.pending:
            self.ready.append(self.pending[0])
        self._release()
        self.pending = event._replace(data=jsontext.dump(out)), {p.run: p.pointer for p in places}
        if ends:
            self._end(ends, documents_first=True)

    def _behind(self, event: Event) -> None:
        if self.pending is None:
            self.ready.append(event)
            return
        self.queued.append(event)
        if sum(len(e.render().encode()) for e in self.queued) > MOST_QUEUED:
            raise Failed("stream_stalled")

    def _release(self) -> None:
        self.ready += self.queued
        self.queued = []

    def _end(self, ends: Ends, documents_first: bool = False) -> None:
        """Runs end: the rest of texts goes into the waiting event, documents into events of their own."""
        rests = {run: rest for run, f in self.texts.items() if run in ends and (rest := _finished(f))}
        served = self._served(ends)
        self.texts = {run: f for run, f in self.texts.items() if run not in ends}
        self.documents = {run: d for run, d in self.documents.items() if run not in ends}
        waiting, self.pending = self.pending, None
        try:
            spoken = [] if waiting is None and not rests else [_placed(waiting, rests)]
        except Failed:
            self.ready += [*([waiting[0]] if waiting else []), *served]
            raise
        if documents_first:
            self.ready += [*served, *spoken]
            self._release()
        else:
            self.ready += spoken
            self._release()
            self.ready += served

    def _served(self, ends: Ends) -> list[Event]:
        """The documents that end, each in the event that opened it."""
        out = []
        for group in sorted({d["group"] for run, d in self.documents.items() if run in ends}, key=int):
            members = {run: d for run, d in self.documents.items() if d["group"] == group}
            if not all(run in ends for run in members):
                raise Failed("stream_unplaceable")
            if ends.all:  # the end of a stream is no end of a document
                raise Refused("tool_arguments_malformed")
            carrier = self.carriers.pop(group)
            data = jsontext.parse(carrier.data)
            for d in members.values():
                chat.write(data, d["pointer"], restoration.embedded(d["raw"], self.look, "tool_arguments_malformed"))
            out.append(carrier._replace(data=jsontext.dump(data)))
        return out


def _copied(node: Any) -> Any:
    if isinstance(node, Members):
        return Members((k, _copied(v)) for k, v in node)
    return [_copied(v) for v in node] if isinstance(node, list) else node


def _event(row: list) -> Event:
    return Event(row[0], row[1], tuple(row[2]))


def _pushed(run: Fragments, text: str) -> str:
    try:
        return run.push(text)
    except ValueError as e:
        raise Failed(str(e)) from None


def _finished(run: Fragments) -> str:
    try:
        return run.finish()
    except ValueError as e:
        raise Failed(str(e)) from None


def _placed(waiting: tuple[Event, dict[str, str]] | None, rests: dict[str, str]) -> Event:
    """The waiting event with what runs held back."""
    if waiting is None or not rests.keys() <= waiting[1].keys():
        raise Failed("stream_unplaceable")
    event, places = waiting
    if not rests:
        return event
    data = jsontext.parse(event.data)
    for run, rest in rests.items():
        chat.write(data, places[run], chat.read(data, places[run]) + rest)
    return event._replace(data=jsontext.dump(data))


def _class(error: str) -> str:
    """A refusal as it is called in a stream."""
    if error == "mapping_unknown_placeholder":
        return "stream_unrestorable"
    return "stream_" + error.removeprefix("mapping_")


OUTPUT = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("event", T.StringType()), T.StructField("error_class", T.StringType())])

_ARROW_OUTPUT = pa.schema([("stream_id", pa.string()), ("seq", pa.int64()), ("ord", pa.int32()), ("event", pa.string()), ("error_class", pa.string())])
#: Events that are given out together.
ROWS_AT_ONCE = 4096


class _Feed:
    """One stream's chunks in order: bytes to events to restored events."""

    def __init__(self, shape: str, client_format: str | None, state: dict[str, Any] | None = None):
        self.shape, self.client_format, self.done = shape, client_format, False
        self.state = state or {"line": None, "rest": "", "begun": False, "stream": None, "values": {}, "literals": []}

    def rows(self, stream_id: str, items: list[tuple[int, bytes, bool, dict[str, str], list[str]]]) -> list[tuple]:
        s, out = self.state, []
        line, framer = Ordered(s["line"]), Framer()
        framer.rest, framer.begun = bytes.fromhex(s["rest"]), s["begun"]
        for seq, chunk, last, values, literals in items:
            s["values"] |= values
            s["literals"] = sorted({*s["literals"], *literals})
            line.add(seq, [chunk.hex(), last])
        stream = Stream(self.shape, s["values"], tuple(s["literals"]), self.client_format)
        if s["stream"]:
            stream.load(s["stream"])
        seq = line.next

        def give(events: list[Event], error: str | None = None) -> None:
            out.extend((stream_id, seq, i, e.render(), error if i == len(events) - 1 else None) for i, e in enumerate(events))

        try:
            for seq, (chunk, last) in line.take():
                try:
                    events, oversized = framer.push(bytes.fromhex(chunk)), None
                except Oversized as e:
                    events, oversized = e.events, e
                for e in events + (framer.finish() if last else []):
                    stream.feed(Event(e["name"], e["data"], tuple(e["other"])))
                if oversized:
                    raise Failed(str(oversized))
                if last:
                    stream.finish()
                give(stream.ready)
                stream.ready = []
                self.done |= last
            if line.over:
                raise Failed("stream_oversized")
        except Failed as e:
            self.done = True
            give(stream.abandon(str(e)), str(e))
        s.update(line=line.dump(), rest=framer.rest.hex(), begun=framer.begun, stream=stream.dump())
        return out


def _items(pdf: pd.DataFrame) -> list[tuple[int, bytes, bool, dict[str, str], list[str]]]:
    return [(int(s), bytes(c or b""), bool(x), dict(v or {}), [] if w is None else list(w)) for s, c, x, v, w in zip(pdf["seq"], pdf["chunk"], pdf["last"], pdf["values"], pdf["literals"], strict=True)]


def _columns(chunks: DataFrame) -> DataFrame:
    literals = F.col("literals") if "literals" in chunks.columns else F.array().cast("array<string>")
    return chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"), "last", "values", literals.alias("literals"))


def restore_events(chunks: DataFrame, shape: str, client_format: str | None = None) -> DataFrame:
    """(stream_id, seq, ord, event, error_class): restored server-sent events of recorded streams.

    chunks: stream_id, seq (0, 1, ... within a stream), chunk (bytes, cut anywhere), last, values (token to value) and, if callers wrote
    tokens, literals (an array).  seq: the chunk that completed the event.  A stream goes through one task in order; streams in parallel.
    Null chunks are empty.  A stream without its last chunk gives what is complete.
    """

    columns = _columns(chunks).withColumn("__row", F.monotonically_increasing_id())
    dealt = columns.repartition("stream_id").sortWithinPartitions("stream_id", F.col("seq").asc_nulls_last(), "__row").drop("__row")

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
        """Each stream with all its chunks; a partition's streams come one after another."""
        own, items = None, None
        for b in batches:
            for id_, *item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if items is None or id_ != own:
                    if items is not None:
                        yield own, items
                    own, items = id_, []
                items.append(item)
        if items is not None:
            yield own, items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for id_, items in streams(batches):
            out += _Feed(shape, client_format).rows(id_, [(int(s), bytes(c or b""), bool(x), dict(v or {}), list(w or ())) for s, c, x, v, w in items])
            if len(out) >= ROWS_AT_ONCE:
                yield pa.RecordBatch.from_pylist([dict(zip(OUTPUT.names, r, strict=True)) for r in out], _ARROW_OUTPUT)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(OUTPUT.names, r, strict=True)) for r in out], _ARROW_OUTPUT)

    return dealt.mapInArrow(run, OUTPUT)


def restore_event_stream(chunks: DataFrame, shape: str, client_format: str | None = None, idle_seconds: int = fragments.IDLE_SECONDS) -> DataFrame:
    """restore_events for a streaming table.  State is bounded: open runs, what waits and what is gathered have limits, a finished stream is a
    mark, and a stream idle for idle_seconds is forgotten after an error event with what is complete."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            if now != fragments.DONE and now["stream"]:
                left = Stream(shape, now["values"], tuple(now["literals"]), client_format).load(now["stream"]).abandon("stream_broken")
                at = now["line"]["next"]
                yield pd.DataFrame([(key[0], at, i, e.render(), "stream_broken" if i == len(left) - 1 else None) for i, e in enumerate(left)], columns=OUTPUT.names)
            state.remove()
            return
        if now != fragments.DONE:
            feed = _Feed(shape, client_format, now)
            out = feed.rows(key[0], [x for pdf in frames for x in _items(pdf)])
            now = fragments.DONE if feed.done else feed.state
            if out:
                yield pd.DataFrame(out, columns=OUTPUT.names)
        state.update((json.dumps(now),))
        state.setTimeoutDuration(idle_seconds * 1000)

    return _columns(chunks).groupBy("stream_id").applyInPandasWithState(run, OUTPUT, fragments.STATE, "append", "ProcessingTimeTimeout")
