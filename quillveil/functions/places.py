"""Where in a text a value would land, and whether it is safe there.

The lexer follows a text piece by piece and knows whether it is in prose, in a string, bare inside a
structure, between backticks or in a comment.  The rule of a place is at least as strict as that of any
place a reader could take it for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

#: Formats that a client may declare, and how many open brackets are followed.
FORMATS = (None, "json", "jsonc", "json5", "markdown")
MOST_OPEN = 32
_PLAIN = re.compile(r"[^\W_ ]*(?:[ .-]+[^\W_ ]*)*")
_JSON_BARE = re.compile(r"[^\W_ ]*(?:[ .@&/-]+[^\W_ ]*)*")
_COMMENT = re.compile(r"//|^/|/$")
_BREAKS = re.compile("[\x00-\x1f]")
_LINES = re.compile("[\u2028\u2029]")


def plain(value: str) -> bool:
    """Letters, digits, spaces, hyphens and full stops only."""
    return _PLAIN.fullmatch(value) is not None


def json_bare_inert(value: str) -> bool:
    return _JSON_BARE.fullmatch(value) is not None and not _COMMENT.search(value)


def json_string_inert(value: str, delimiter: str = '"') -> bool:
    """Nothing that would end or bend a quoted string."""
    return delimiter not in value and "\\" not in value and not _BREAKS.search(value) and not _LINES.search(value)


def string_inert(column: Column) -> Column:
    """json_string_inert over a column."""
    return ~column.rlike('["\\\\\\x00-\\x1f\\u2028\\u2029]')


def plain_column(column: Column) -> Column:
    """plain over a column."""
    return column.rlike(r"^(?U:[\w&&[^\p{M}\p{Pc}_]]|[ .-])*$")


def bare_inert(column: Column) -> Column:
    """json_bare_inert over a column."""
    return column.rlike(r"^(?U:[\w&&[^\p{M}\p{Pc}_]]|[ .@&/-])*$") & ~column.contains("//") & ~column.startswith("/") & ~column.endswith("/")


class Lexer:
    def __init__(self, client_format: str | None = None):
        if client_format not in FORMATS:
            raise ValueError(f"unknown format {client_format!r}")
        self.format = client_format
        self.open: list[str] = []
        self.string: str | None = None
        self.escaped = self.poisoned = self.ticked = False
        self.comment: str | None = None  # line or block
        self.last = ""

    def dump(self) -> dict:
        """The state, to go on from later."""
        return dict(vars(self))

    @classmethod
    def load(cls, state: dict) -> Lexer:
        lexer = cls(state["format"])
        vars(lexer).update(state, open=list(state["open"]))
        return lexer

    @property
    def place(self) -> str:
        if self.poisoned:
            return "poisoned"
        if self.string:
            return "text"
        if self.comment:
            return "comment"
        if self.ticked:
            return "ticked"
        return "bare" if self.open else "prose"

    def feed(self, text: str) -> None:
        for c in text:
            self._take(c)
            self.last = c

    def _take(self, c: str) -> None:
        if self.poisoned:
            return
        if self.string:
            if self.escaped:
                self.escaped = False
            elif c == "\\":
                self.escaped = True
            elif c == self.string:
                self.string = None
            elif c < " " or c in "\u2028\u2029" and self.format not in ("json", "jsonc"):
                self.poisoned = True
            return
        if self.comment:
            if self.comment == "line" and c in "\n\r" or self.comment == "block" and self.last == "*" and c == "/":
                self.comment, self.last = None, ""
            return
        if c == "`" and self.format in (None, "markdown"):
            self.ticked = not self.ticked
        elif self.ticked:
            return
        elif c in "{[":
            if len(self.open) == MOST_OPEN:
                self.poisoned = True
            else:
                self.open.append(c)
        elif c in "}]" and self.open:
            if (self.open.pop() == "{") != (c == "}"):
                self.poisoned = True
        elif self.open and (c == '"' or c == "'" and self.format in (None, "json5")):
            self.string = c
        elif self.open and self.format != "json" and self.last == "/" and c in "/*":
            self.comment = "line" if c == "/" else "block"

    def safe(self, value: str) -> bool:
        """Whether the value may be put where the lexer is."""
        place, json_like = self.place, self.format in ("json", "jsonc", "json5")
        if place == "text":
            return json_string_inert(value, self.string or '"')
        if place == "prose":
            return json_bare_inert(value) if json_like else True
        if place == "ticked" and self.format == "markdown":
            return "`" not in value and not _BREAKS.search(value) and not _LINES.search(value)
        if place == "poisoned" or not json_like:
            return plain(value)
        return json_bare_inert(value)
