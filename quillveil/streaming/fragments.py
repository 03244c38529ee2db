"""Restoring placeholders in texts that arrive in fragments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.places import Lexer
from ..operators.pseudonyms import TOKEN

#: Characters held back, and what one event may hold.
MOST_HELD, MOST_EVENT = 64, 1 << 20
_TOKEN = re.compile(TOKEN)
_BEGUN = re.compile(r"\[(?:[A-Z][A-Z_]*(?:_[0-9]*)?)?$")


class Fragments:
    """Text in, restored text out; what may be the beginning of a token is held back until more arrives.

    lexer: follows what is given out; a value that is not safe in its place is refused (strict) or its token stays.
    """

    def __init__(self, values: dict[str, str], strict: bool = True, held: str = "", lexer: Lexer | None = None):
        self.values, self.strict, self.held, self.lexer = values, strict, held, lexer

    def _restored(self, text: str) -> str:
        out, at = [], 0
        for m in _TOKEN.finditer(text):
            self._give(out, text[at : m.start()])
            value = self.values.get(m[0])
            error = "stream_unrestorable" if value is None else "stream_unsafe_place" if self.lexer and value != m[0] and not self.lexer.safe(value) else None
            if error and self.strict:
                raise ValueError(error)
            self._give(out, m[0] if error else value, literal=bool(error) or value == m[0])
            at = m.end()
        self._give(out, text[at:])
        return "".join(out)

    def _give(self, out: list[str], text: str, literal: bool = False) -> None:
        out.append(text)
        if self.lexer and not literal:  # a token's own brackets are no structure
            self.lexer.feed(text)

    def push(self, chunk: str) -> str:
        text = self.held + chunk
        begun = _BEGUN.search(text[-MOST_HELD:])
        cut = len(text) - len(text[-MOST_HELD:]) + begun.start() if begun else len(text)
        self.held = text[cut:]
        return self._restored(text[:cut])

    def finish(self) -> str:
        rest, self.held = self._restored(self.held), ""
        return rest


OUTPUT = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("text", T.StringType()), T.StructField("error_class", T.StringType())])
STATE = T.StructType([T.StructField("state", T.StringType())])
#: Fragments that may wait for one before them, their characters, and seconds without a fragment after which a stream is over.
MOST_WAITING, MOST_WAITING_CHARS, IDLE_SECONDS = 256, 1 << 20, 1800
DONE = {"done": True}


class Ordered:
    """Items of a stream by their number: given out in order, each once, whatever order they come in; what waits is bounded."""

    def __init__(self, state: dict[str, Any] | None = None):
        self.next, self.waiting = (state["next"], dict(state["waiting"])) if state else (0, {})

    def dump(self) -> dict[str, Any]:
        return {"next": self.next, "waiting": self.waiting}

    def add(self, seq: int, item: list) -> None:
        if seq >= self.next:
            self.waiting.setdefault(str(int(seq)), item)

    def take(self) -> Iterator[tuple[int, list]]:
        while (item := self.waiting.pop(str(self.next), None)) is not None:
            self.next += 1
            yield self.next - 1, item

    @property
    def over(self) -> bool:
        return len(self.waiting) > MOST_WAITING or sum(len(x[0] or "") for x in self.waiting.values()) > MOST_WAITING_CHARS


def restore_stream(fragments: DataFrame, strict: bool = True, client_format: str | None = None, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """(stream_id, seq, text, error_class) of a streaming table of fragments.

    fragments: stream_id, seq (0, 1, ... within a stream), chunk, last, values (token to value, such as from a
    join with the mapping).  Fragments out of order wait in the state, a bounded number of them, for those before them; repeated ones are ignored.
    A value that isn't safe where it would land (client_format: how the client reads the text) is refused, or its token stays.
    After its last fragment or an error a stream gives nothing more, and its state shrinks to a mark; a stream that has been idle for
    idle_seconds is forgotten (a late fragment begins it anew).
    """

    def rows(now: dict[str, Any], stream: str) -> Iterator[tuple[str, int, str | None, str | None]]:
        line = Ordered(now["line"])
        for frame in now.pop("frames"):
            for seq, chunk, last, values in frame:
                now["values"] |= values
                line.add(seq, [chunk, last])
        work = Fragments(now["values"], strict, now["held"], Lexer.load(now["lexer"]))
        seq = line.next
        try:
            for seq, (chunk, last) in line.take():
                yield stream, seq, work.push(chunk or "") + (work.finish() if last else ""), None
                if last:
                    now["done"] = True
                    return
            if line.over:
                seq = line.next
                raise ValueError("stream_oversized")
        except ValueError as e:
            now["done"] = True
            yield stream, seq, None, str(e)
        now.update(line=line.dump(), held=work.held, lexer=work.lexer.dump())

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else {"line": None, "held": "", "lexer": Lexer(client_format).dump(), "values": {}}
        if now != DONE:
            now["frames"] = [[(int(s), c, bool(x), dict(v or {})) for s, c, x, v in zip(pdf["seq"], pdf["chunk"], pdf["last"], pdf["values"], strict=True)] for pdf in frames]
            out = list(rows(now, key[0]))
            now = DONE if now.get("done") else now
            if out:
                yield pd.DataFrame(out, columns=OUTPUT.names)
        state.update((json.dumps(now),))
        state.setTimeoutDuration(idle_seconds * 1000)

    return fragments.groupBy("stream_id").applyInPandasWithState(run, OUTPUT, STATE, "append", "ProcessingTimeTimeout")


class Oversized(ValueError):
    """An event over the limit; events: those before it."""

    def __init__(self, events: list[dict[str, Any]]):
        super().__init__("stream_oversized")
        self.events = events


class Framer:
    """Server-sent events from byte chunks of any size."""

    def __init__(self):
        self.rest, self.begun = b"", False

    def push(self, chunk: bytes) -> list[dict[str, Any]]:
        """The events that the chunk completes: name, data, and other lines."""
        self.rest += chunk
        if not self.begun:
            if self.rest[:3] == b"\xef\xbb\xbf":
                self.rest = self.rest[3:]
            elif b"\xef\xbb\xbf".startswith(self.rest):
                return []
            self.begun = True
        out = []
        while (end := self._end()) is not None:
            block, self.rest = self.rest[: end[0]], self.rest[end[1] :]
            if block.strip(b"\r\n"):
                out.append(self._event(block.decode("utf-8", "replace")))
        if len(self.rest) > MOST_EVENT:
            raise Oversized(out)
        return out

    def finish(self) -> list[dict[str, Any]]:
        """An event that the end of the stream completes."""
        block, self.rest = self.rest.strip(b"\r\n"), b""
        return [self._event(block.decode("utf-8", "replace"))] if block else []

    def _end(self) -> tuple[int, int] | None:
        m = re.search(rb"(?:\r\n|\n|\r(?!\n|\Z))(?:\r\n|\n|\r(?!\Z))", self.rest)
        if m is None:
            return None
        return m.start(), m.end()

    @staticmethod
    def _event(block: str) -> dict[str, Any]:
        name, data, other = None, [], []
        for line in re.split(r"\r\n|\n|\r", block):
            field, colon, value = line.partition(":")
            value = value.removeprefix(" ")
            if field == "event" and colon:
                name = value
            elif field == "data" and colon:
                data.append(value)
            elif line:
                other.append(line)
        return {"name": name, "data": "\n".join(data) if data else None, "other": other}
