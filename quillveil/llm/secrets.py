"""Secret scans with a recursive decoding worklist.

Each text is scanned as it is (the base layer).  Then a worklist unwraps nested layers until nothing
new appears: percent-encoding and Unicode escapes decode a layer in place, with a position map;
base64 runs (also over several lines) decode to a layer of their own, and gzip, zlib or bzip2 data inside is expanded.
Where a run doesn't decode to text as a whole, as other characters are joined to the encoded ones or text is among other bytes, the stretches
of UTF-8 and UTF-16 text and the compressed data in what it decodes to from each of its first four characters are layers; of compressed data that
breaks off, what comes before is.  Every layer is scanned again; a digest of each layer seen stops cycles.  A finding in a layer is mapped back to
the span of the original text that produced it (for base64 and compressed data, the whole run).
Findings of the base layer always stay; a decoded finding with an equal kind and span adds nothing.

Row by row, no shuffle.  Null text: as if empty.  Repeated rows: each by itself.  Texts of any length are read
whole, and so are all members of compressed data (gzip, zlib, bzip2, xz; raw deflate has no mark to be known by).  A compressed layer over ``inflate_bytes`` isn't
held at once: it is expanded as a stream, through any further compression, into windows that overlap and are cut where no encoded
run is, and each window is a layer that is unwrapped like any other.  Only where an encoded run is longer than an eighth of a window are its
pieces decoded apart; ``n_unread`` counts the base64 runs of the text (or of a layer) in which that happened, and redaction replaces these whole.

Layers are visited depth first and held only along one path.  From the eighth layer on, a chain of escapes at one place (``%252525..41``) is followed to its end
at once, so deep nests take linear time.  Positions are kept as arrays of runs, a few numbers for each encoded run.  Lines of base64 under 16 characters
are not joined.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

#: The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that only line breaks separate, the last of any length.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]{16,}+)*\r?\n[A-Za-z0-9+/_-]++={0,2}")
#: In decoded bytes: text long enough for a finding, and where compressed data may begin.
_STRETCH = re.compile(rb"(?:[\t\n\r -~]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){14,}")
_WIDE = {order: re.compile(pattern) for order, pattern in (("utf-16-le", rb"(?:[\t\n\r -~]\0){14,}"), ("utf-16-be", rb"(?:\0[\t\n\r -~]){14,}"))}
_ZLIB = b"|".join(b"\\x%02x[%s]" % (a, b"".join(b"\\x%02x" % b for b in range(256) if (a << 8 | b) % 31 == 0 and not b & 32)) for a in range(8, 128, 16))
_PACKED = re.compile(rb"(?=\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ|" + _ZLIB + rb")", re.S)
_ASCII = np.zeros(256, bool)
_ASCII[[9, 10, 13, *range(32, 127)]] = True
_CONTROL = ~_ASCII
_CONTROL[0x80:0xC0] = _CONTROL[0xC2:0xF5] = False
_B64_BYTE = np.zeros(256, bool)
_B64_BYTE[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8)] = True
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[np.frombuffer(b"0123456789abcdef", np.uint8)] = True

SPAN = T.StructType([K.field("kind", T.StringType()), K.field("start", T.LongType()), K.field("end", T.LongType()), K.field("path", T.StringType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())]))


def find(text: str) -> list[tuple[str, int, int]]:
    """The findings of one layer, kind by kind, leftmost and non-overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]


class _Map:
    """Where the characters of a decoded layer come from, as runs: character k of a run comes from width characters at lo + k * step.

    above: the map of the layer that was decoded, None for the text itself.
    """

    __slots__ = ("at", "lo", "step", "width", "above")

    def __init__(self, above: _Map | None):
        self.at, self.lo, self.step, self.width = array("q"), array("q"), array("q"), array("q")
        self.above = above

    def add(self, at: int, lo: int, step: int, width: int) -> None:
        for column, value in ((self.at, at), (self.lo, lo), (self.step, step), (self.width, width)):
            column.append(value)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text itself that characters start to end come from."""
        layer = self
        while layer:
            i, j = bisect_right(layer.at, start) - 1, bisect_right(layer.at, end - 1) - 1
            start, end = layer.lo[i] + (start - layer.at[i]) * layer.step[i], layer.lo[j] + (end - 1 - layer.at[j]) * layer.step[j] + layer.width[j]
            layer = layer.above
        return start, end


def _whole(start: int, end: int, above: _Map | None) -> _Map:
    """All characters come from one span."""
    out = _Map(above)
    out.add(0, start, 0, end - start)
    return out


#: A decoded piece: its text, where its first character begins, and from one character to the next the step and the width.
Run = tuple[str, int, int, int]


def _in_place(text: str, pattern: re.Pattern, decode: Callable[[re.Match], list[Run] | None], above: _Map | None) -> tuple[str, _Map] | None:
    """Text with its encoded runs decoded, and where its characters come from; None if nothing changed."""
    out, origin, at, size = [], _Map(above), 0, 0
    for m in pattern.finditer(text):
        if (runs := decode(m)) is None:
            continue
        for piece, lo, step, width in ((text[at : m.start()], at, 1, 1), *runs):
            if piece:
                out.append(piece)
                origin.add(size, lo, step, width)
                size += len(piece)
        at = m.end()
    if not at:
        return None
    if at < len(text):
        out.append(text[at:])
        origin.add(size, at, 1, 1)
    return "".join(out), origin


def _runs_of(pieces: Iterable[tuple[str, int]], at: int) -> list[Run]:
    """Runs of (character, width) pieces that follow each other from a place on."""
    out = []
    for width, group in groupby(pieces, key=lambda x: x[1]):
        text = "".join(c for c, _ in group)
        out.append((text, at, width, width))
        at += width * len(text)
    return out


def _percent(m: re.Match) -> list[Run] | None:
    raw = binascii.unhexlify(m[0].replace("%", ""))
    try:
        decoded = raw.decode("utf-8")
    except UnicodeDecodeError:  # other bytes stand for themselves
        return [(raw.decode("latin-1"), m.start(), 3, 3)]
    return _runs_of(((c, 3 * len(c.encode())) for c in decoded), m.start()) if not raw.isascii() else [(decoded, m.start(), 3, 3)]


def _escape(m: re.Match) -> list[Run] | None:
    s = m[0]
    if s.startswith("\\u") and s[2] != "{":
        pieces, codes = [], [int(s[i + 2 : i + 6], 16) for i in range(0, len(s), 6)]
        i = 0
        while i < len(codes):
            pair = 0xD800 <= codes[i] < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1] < 0xE000
            c = 0x10000 + ((codes[i] - 0xD800) << 10) + codes[i + 1] - 0xDC00 if pair else codes[i]
            pieces.append(("\ufffd" if 0xD800 <= c < 0xE000 else chr(c), 6 * (1 + pair)))
            i += 1 + pair
        return _runs_of(pieces, m.start())
    digits = s.strip("\\uUx{}&#X;")
    c = int(digits, 10 if s.startswith("&#") and s[2] not in "xX" else 16)
    return None if c > 0x10FFFF or 0xD800 <= c < 0xE000 else [(chr(c), m.start(), 0, m.end() - m.start())]


#: One escape, and what follows a decoded character that may begin another.
_UNIT = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_REST = {"%": re.compile(r"[0-9A-Fa-f]{2}"), "\\": re.compile(r"u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f]{1,6}\}"), "&": re.compile(r"#[0-9]{1,7};|#[xX][0-9A-Fa-f]{1,6};")}


def _ascii(unit: str) -> str | None:
    """The ASCII character of an escape; other characters may need their neighbours."""
    digits = unit.strip("%\\uUx{}&#X;")
    c = int(digits or "0", 10 if unit.startswith("&#") and unit[2] not in "xX" else 16)
    return chr(c) if c < 128 else None


def _chained(text: str, above: _Map | None) -> tuple[str, _Map] | None:
    """Text in which each chain of escapes at one place gives way to the character at its end; None if there is none."""
    out, origin, at, size, m = [], _Map(above), 0, 0, _UNIT.search(text)
    while m:
        c, end, steps = _ascii(m[0]), m.end(), 1
        while c in _REST and (more := _REST[c].match(text, end)) and (then := _ascii(c + more[0])) is not None:
            c, end, steps = then, more.end(), steps + 1
        if steps > 1:
            for piece, lo, step, width in ((text[at : m.start()], at, 1, 1), (c, m.start(), 0, end - m.start())):
                if piece:
                    out.append(piece)
                    origin.add(size, lo, step, width)
                    size += len(piece)
            at = end
        m = _UNIT.search(text, end)
    if not at:
        return None
    if at < len(text):
        out.append(text[at:])
        origin.add(size, at, 1, 1)
    return "".join(out), origin


#: Bytes that a decompressor gives at once, and those first given to one: most places that look like compressed data aren't.
_GIVEN, _TRIED = 1 << 20, 1 << 10
_BROKEN = (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError)


def _pieces(data: bytes | memoryview) -> Iterator[bytes]:
    view, at, size = memoryview(data), 0, _TRIED
    while at < len(view):
        yield bytes(view[at : at + size])
        at, size = at + size, min(4 * size, _GIVEN)


def _members(pieces: Iterator[bytes], read: list[int] | None = None) -> Iterator[bytes]:
    """Expanded data of all members that follow each other, as far as it goes; nothing if there is no first one.

    read: gets how many bytes all members took, once one has ended.
    """
    rest, taken, first = b"", 0, True
    try:
        while True:
            while len(rest) < 3 and (piece := next(pieces, b"")):
                taken += len(piece)
                rest = rest + piece if first else (rest + piece).lstrip(b"\0")  # gzip files may be padded
            if not rest:
                return
            if not _packed(rest):
                if not first:  # not compressed, but read all the same
                    yield rest
                    yield from pieces
                return
            d = bz2.BZ2Decompressor() if rest[:3] == b"BZh" else lzma.LZMADecompressor() if rest[:3] == b"\xfd7z" else zlib.decompressobj(47)
            first = False
            while not d.eof:
                if not rest:
                    if not (rest := next(pieces, b"")):
                        return
                    taken += len(rest)
                out = d.decompress(rest, _GIVEN)
                yield out
                while not d.eof and (out or d.unconsumed_tail if hasattr(d, "unconsumed_tail") else not d.needs_input):
                    out = d.decompress(getattr(d, "unconsumed_tail", b""), _GIVEN)
                    yield out
                rest = b""
            rest = d.unused_data.lstrip(b"\0")
            if read is not None:
                read[:] = [taken - len(rest)]
    except _BROKEN:  # what came before is read
        return


def _packed(data: bytes | memoryview) -> bool:
    head = bytes(data[:3])
    return head in (b"BZh", b"\xfd7z") or head[:2] == b"\x1f\x8b" or len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0


def _unpacked(stream: Iterator[bytes], heads: set[bytes]) -> tuple[Iterator[bytes], int]:
    """A stream with its nested compression undone, and how many layers that were; heads: beginnings of layers, so that no cycle goes on."""
    head = b""
    while len(head) < 4096 and (piece := next(stream, b"")):
        head += piece
    stream = chain([head], stream)
    if not _packed(head) or head[:4096] in heads:
        return stream, 0
    heads.add(head[:4096])
    taken: list[bytes] | None = []

    def kept() -> Iterator[bytes]:
        for piece in stream:
            if taken is not None:
                taken.append(piece)
            yield piece

    inner = filter(None, _members(kept()))
    if not (first := next(inner, b"")):
        return chain(taken, stream), 0
    taken = None
    below, depth = _unpacked(chain([first], inner), heads)
    return below, depth + 1


def _expanded(data: bytes | memoryview, most: int, read: list[int] | None = None) -> tuple[Iterator[bytes], int]:
    """Data with its nested compression undone, in one piece or, if it is larger than most, as a stream; how many layers that were."""
    depth, seen = 0, set()
    while _packed(data):
        stream, got, size = filter(None, _members(_pieces(data), None if depth else read)), [], 0
        for piece in stream:
            got.append(piece)
            size += len(piece)
            if size > most:
                below, more = _unpacked(chain(got, stream), set())
                return below, depth + 1 + more
        if not got:
            break
        data, depth = b"".join(got), depth + 1
        if (key := hashlib.sha256(data).digest()) in seen:
            break
        seen.add(key)
    return iter((data,)), depth


_RUN_BYTE = np.zeros(256, bool)
_RUN_BYTE[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n", np.uint8)] = True


def _windows(stream: Iterator[bytes], most: int, cut: list[bool]) -> Iterator[bytes]:
    """A stream in windows of about most bytes that overlap; cut: gets an entry if one ends within an encoded run."""
    held, size, fresh = [], 0, False
    for piece in stream:
        held.append(piece)
        size, fresh = size + len(piece), True
        if size <= most:
            continue
        data = b"".join(held)
        end = np.flatnonzero(~_RUN_BYTE[np.frombuffer(data[-most // 8 :], np.uint8)])
        to = len(data) - min(len(data), -(-most // 8)) + int(end[-1]) + 1 if len(end) else len(data)
        if not len(end):
            cut.append(True)
        yield data[:to]
        held, fresh = [data[max(0, to - min(4096, most // 2)) :]], to < len(data)
        size = len(held[0])
    if fresh:
        yield b"".join(held)


def _readable(data: bytes) -> str | None:
    """Text in decoded bytes: UTF-8 with hardly any control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(c < " " and c not in "\t\n\r" for c in text)
    return text if text and odd * 20 <= len(text) else None


def _texts(data: bytes) -> list[str]:
    """The texts in decoded bytes: all of them, or, among other bytes, stretches of UTF-8 and of UTF-16."""
    if (whole := _readable(data)) is not None:
        return [whole]
    out, each = [], np.frombuffer(data, np.uint8)
    plain = K.find_words(each, np.array([0, len(each)]), ~_ASCII)  # a finding or another layer needs so many of these in a row
    long = plain.end - plain.start >= 14
    if long.any():  # a stretch ends where a byte can't be of UTF-8 text
        breaks = np.concatenate([[-1], np.flatnonzero(_CONTROL[each]), [len(each)]])
        at = np.unique(np.searchsorted(breaks, plain.start[long]))
        for lo, hi in zip((breaks[at - 1] + 1).tolist(), breaks[at].tolist(), strict=True):
            out += [m[0].decode("utf-8", "ignore") for m in _STRETCH.finditer(data, lo, hi)]
    none = each == 0
    if (none[:-6] & none[2:-4] & none[4:-2] & none[6:]).any():
        for order, pattern in _WIDE.items():
            out += [m[0].decode(order, "ignore") for m in pattern.finditer(data)]
    return out


def _decoded(run: str, most: int, cut: list[bool]) -> Iterator[tuple[str, str]]:
    """(text, layer name) in a base64 run; cut: gets an entry if a run in it was decoded in pieces."""
    run = run.replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")

    def expanded(data: bytes | memoryview, read: list[int]) -> Iterator[tuple[str, str]]:
        stream, depth = _expanded(data, most, read)
        if depth:
            name = "base64" + ">inflate" * depth
            for window in _windows(stream, most, cut):
                yield from ((text, name) for text in _texts(window))

    for phase in range(4):
        body = run[phase:]
        body = body[: len(body) - (len(body) % 4 == 1)]
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
        covered = 0
        if not phase:
            any_ = False
            for layer in expanded(raw, read := []):
                any_ = True
                yield layer
            if any_ or read:
                break
        yield from ((text, "base64") for text in _texts(raw))
        if not phase and len(run) % 4 != 1 and _readable(raw) is not None:
            break
        for m in _PACKED.finditer(raw):
            if m.start() % 3 == 0 and m.start() >= covered and (phase or m.start()):
                yield from expanded(memoryview(raw)[m.start() :], read := [])
                covered = m.start() + read[0] if read else covered  # members that were read to their end aren't read again


def unwrap(text: str, inflate_bytes: int = 1 << 26, gaps: list[tuple[int, int]] | None = None) -> tuple[list[tuple[str, int, int, str]], int]:
    """Findings of all layers below the text, mapped to its spans, and how many runs were decoded in pieces.

    gaps: gets the spans of the text that hold these.
    """
    found: list[tuple[str, int, int, str]] = []
    unread = 0
    seen = {_digest(text)}

    def below(layer: str, origin: _Map | None, path: str, depth: int) -> Iterator[tuple[str, _Map, str, int, bytes]]:
        nonlocal unread
        way = f"{path}>" if path else ""
        if depth >= 8 and (got := _chained(layer, origin)):
            yield *got, f"{way}chain", depth + 1, b""
        else:
            for name, pattern, decode in (("url", PERCENT, _percent), ("unicode", ESCAPE, _escape)):
                if ("%" if name == "url" else "\\") in layer or name == "unicode" and "&#" in layer:
                    if got := _in_place(layer, pattern, decode, origin):
                        yield *got, f"{way}{name}", depth + 1, b""
        for m in chain(BASE64.finditer(layer), WRAPPED.finditer(layer)):
            own, cut = _whole(m.start(), m.end(), origin), []
            at = own.span(0, 1)
            for inside, name in _decoded(m[0], inflate_bytes, cut):
                yield inside, own, f"{way}{name}", depth + 1, b"\0%d" % at[0]
            if cut:
                unread += 1
                if gaps is not None:
                    gaps.append(at)

    path = [below(text, None, "", 0)]
    while path:
        if (layer := next(path[-1], None)) is None:
            path.pop()
            continue
        inside, own, way, depth, place = layer
        if (key := _digest(inside, place)) not in seen:
            seen.add(key)
            found.extend((kind, *own.span(i, j), way) for kind, i, j in find(inside))
            path.append(below(inside, own, way, depth))
    return found, unread


def _digest(text: str, place: bytes = b"") -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass") + place).digest()


def _runs(buf: np.ndarray, off: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """Which documents hold a run of so many bytes of the table."""
    w = K.find_words(buf, off, ~table)
    hit = np.zeros(len(off) - 1, bool)
    hit[w.doc[w.end - w.start >= least]] = True
    return hit


def scan_chunk(buf: np.ndarray, off: np.ndarray, inflate_bytes: int, gaps: dict[int, list[tuple[int, int]]] | None = None) -> tuple[list[list[tuple[str, int, int, str]]], list[int]]:
    """Spans of each document by start, kind and end; documents that cannot hold any are not looked into.

    gaps: gets the spans of runs decoded in pieces, by document.
    """
    hexes, runs = _runs(buf, off, _HEX_BYTE, LEAST["hex"]), _runs(buf, off, _B64_BYTE, 16)
    data, folded = buf.tobytes(), K.LOWER[buf].tobytes()
    spans, unread = [], []
    for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        raw, low = data[a:b], folded[a:b]
        plain = hexes[d] or b"AKIA" in raw or any(k in low for k in _KEYWORDS)
        deep = runs[d] or b"%" in raw or b"\\" in raw or b"&#" in raw
        if not (plain or deep):
            spans.append([])
            unread.append(0)
            continue
        text = raw.decode("utf-8", "replace")
        own = [(*x, "") for x in find(text)] if plain else []
        more, left = unwrap(text, inflate_bytes, at := []) if deep else ([], 0)
        if left and gaps is not None:
            gaps[d] = at
        have = {x[:3] for x in own}
        for x in more:
            if x[:3] not in have:
                have.add(x[:3])
                own.append(x)
        spans.append(sorted(own, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))
        unread.append(left)
    return spans, unread


def scan_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None, inflate_bytes: int = 1 << 26) -> DataFrame:
    """The kept columns (all, unless named), secret_spans (path: the layers passed, empty for the text itself) and n_unread.

    Extra columns with these names are replaced.
    """

    def kernel(buf: np.ndarray, off: np.ndarray) -> dict[str, object]:
        spans, unread = scan_chunk(buf, off, inflate_bytes)
        names = ("kind", "start", "end", "path")
        return {"secret_spans": pa.array([[dict(zip(names, x, strict=True)) for x in row] for row in spans], _ARROW_SPANS), "n_unread": np.array(unread, np.int64)}

    return K.map_text(df, text, [K.field("secret_spans", T.ArrayType(SPAN)), K.field("n_unread", T.LongType())], kernel, df.columns if keep is None else keep)


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = "n_chars", inflate_bytes: int = 1 << 26) -> DataFrame:
    """df with every secret span (overlapping ones as one), and every run that n_unread counts, replaced in its text; same columns, all rows.

    length: a column that holds the text's code points; it is set anew in rows whose text changed.
    """
    length = length if length in df.columns else None
    fields = [df.schema[text], *([df.schema[length]] if length else [])]
    keep = [c for c in df.columns if c not in (text, length)]

    def kernel(buf: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> dict[str, object]:
        gaps: dict[int, list[tuple[int, int]]] = {}
        spans, _ = scan_chunk(buf, off, inflate_bytes, gaps)
        old = batch.column(batch.schema.get_field_index(text))
        sizes = batch.column(batch.schema.get_field_index(length)) if length else None
        if not any(spans) and not gaps:
            return {text: old} | ({length: sizes} if length else {})
        texts, counts = old.to_pylist(), sizes.to_pylist() if length else []
        for i, row in enumerate(spans):
            if row or i in gaps:
                texts[i] = mask(texts[i], [(a, b) for _, a, b, _ in row] + gaps.get(i, []), mark)
                if length:
                    counts[i] = len(texts[i])
        return {text: pa.array(texts, old.type)} | ({length: pa.array(counts, sizes.type)} if length else {})

    lengths = keep + ([length] if length else [])
    return _map_all(df, text, fields, kernel, lengths).select(*df.columns)


def _map_all(df: DataFrame, text: str, fields: list[T.StructField], kernel, keep: list[str]) -> DataFrame:
    names = {f.name for f in fields}
    order = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in order] + fields)

    def run(batches):
        for whole in batches:
            for b in K.slices(whole, text):
                out = kernel(*K.utf8(b.column(b.schema.get_field_index(text))), b)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in order] + [out[f.name] for f in fields], names=schema.names)

    return df.mapInArrow(K.frees(run), schema)


def mask(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with the union of the spans replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    base = F.filter("secret_spans", lambda x: x["path"] == "")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"), "n_unread")
