"""Token ids of whole texts with a public word-level BPE vocabulary, at array speed.

The library's tokenizer is the reference: each distinct piece of text is encoded by it once in a
worker, and texts are put together from pieces.  Pieces are cut as its own rules cut them (contractions, runs
of letters, single digits, runs of other characters, after lower-casing).  Texts with characters outside a
set for which that holds exactly go to the library whole, so the ids are always the library's.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import textkit as K

VOCABULARY = "word_bpe_49k.json"
#: Appended to each document.
END_ID = 1
_LIMIT = 600_000  # pieces remembered by a worker
_OTHER, _SPACE, _LETTER, _DIGIT, _ODD = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point below 0x250; _ODD means that the library must see the text."""
    kind, low = np.full(0x251, _ODD, np.int8), np.arange(0x251, dtype=np.uint32)
    for c in range(0x250):
        s = chr(c)
        if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
            kind[c] = _SPACE
        elif c < 32 or 0x7F <= c < 0xA0 or c == 0x130:
            continue
        elif s.isalpha():
            if len(s.lower()) == 1 and ord(s.lower()) < 0x250:
                kind[c], low[c] = _LETTER, ord(s.lower())
        elif s.isdigit() and c < 128:
            kind[c] = _DIGIT
        elif not s.isnumeric():
            kind[c] = _OTHER
    return kind, low


def _spaced(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bytes with a space after every text."""
    docs = len(off) - 1
    wide = np.full(len(buf) + docs, 32, np.uint8)
    wide[np.arange(len(buf)) + np.repeat(np.arange(docs), np.diff(off))] = buf
    return wide


class Encoder:
    """ids(buf, off) gives all token ids of a chunk and where each text's begin."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.kind, self.low = _classes()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])
        self._forget()

    def _forget(self) -> None:
        self.hash, self.start, self.count, self.flat = np.zeros(0, K.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces, many in one text; a piece's last id ends a word."""
        out: list[np.ndarray] = []
        for at in range(0, len(pieces), 2000):
            part = pieces[at : at + 2000]
            ids = self.whole([" ".join(part)])[0]
            cut = np.flatnonzero(self.ends[ids]) + 1
            out += np.split(ids, cut[:-1]) if len(cut) == len(part) and cut[-1] == len(ids) else self.whole(part)
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids = self._pieces(pieces)
        count = np.array([len(x) for x in ids], np.int64)
        start = len(self.flat) + np.concatenate([[0], np.cumsum(count)[:-1]])
        self.flat = np.concatenate([self.flat, *ids])
        both = np.concatenate([self.hash, hashes])
        order = np.argsort(both, kind="stable")
        self.hash, self.start, self.count = both[order], np.concatenate([self.start, start])[order], np.concatenate([self.count, count])[order]

    def _cut(self, kind: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece; the texts are separated by spaces."""
        begin = np.ones(len(kind), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        apostrophe = np.flatnonzero((low == 39) & begin)
        apostrophe = apostrophe[apostrophe + 1 < len(low)]
        apostrophe = apostrophe[kind[apostrophe + 1] == _LETTER]  # a run of one
        if len(apostrophe):
            pad = np.append(low, [0, 0, 0])
            a, b = pad[apostrophe + 1], pad[apostrophe + 2]
            two = np.isin(a, [ord(c) for c in "stmd"])
            three = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for at, size in ((apostrophe[two], 2), (apostrophe[three & ~two], 3)):
                begin[at + 1] = False
                after = at + size
                after = after[after < len(begin)]
                begin[after] = True
        first = np.flatnonzero(begin)
        last = np.append(first[1:], len(kind))
        use = kind[first] != _SPACE
        return first[use], last[use]

    def ids(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = len(off) - 1
        wide = _spaced(buf, off)
        try:
            points = np.frombuffer(wide.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:  # malformed bytes become U+FFFD, text by text
            texts = [t.encode() for t in K.strings(buf, off)]
            buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            wide = _spaced(buf, off)
            points = np.frombuffer(wide.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        edge = off + np.arange(docs + 1)
        first = K.code_points(wide)[edge]
        small = np.minimum(points, 0x250)
        kind = self.kind[small]
        odd = np.zeros(docs, bool)
        where = np.flatnonzero(kind == _ODD)
        odd[np.searchsorted(first, where, side="right") - 1] = True
        if odd.any():
            kind[np.repeat(odd, np.diff(first))] = _SPACE
        low = self.low[small]
        a, b = self._cut(kind, low)
        h = K.range_hashes(low.view(np.uint8), 4 * a, 4 * b, lower=False)
        at = self._places(h, low, a, b)
        count = self.count[at]
        doc_pieces = np.searchsorted(a, first)
        tokens = np.concatenate([[0], np.cumsum(count)])
        flat = self.flat[np.repeat(self.start[at] - tokens[:-1], count) + np.arange(tokens[-1])]
        starts = tokens[doc_pieces]
        if odd.any():
            parts = np.split(flat, starts[1:-1])
            which = np.flatnonzero(odd)
            data = buf.tobytes()
            for d, x in zip(which.tolist(), self.whole([data[off[d] : off[d + 1]].decode("utf-8") for d in which.tolist()]), strict=True):
                parts[d] = x
            return np.concatenate(parts).astype(np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return flat, starts

    def _places(self, h: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where each piece is among those remembered, after learning the new ones."""
        if not len(h):
            return np.zeros(0, np.int64)
        order = np.argsort(h)
        s = h[order]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        own, one = s[edge], order[edge]
        for _ in range(2):
            at = np.minimum(np.searchsorted(self.hash, own), max(len(self.hash) - 1, 0))
            new = self.hash[at] != own if len(self.hash) else np.ones(len(own), bool)
            if not new.any():
                break
            if len(self.hash) + int(new.sum()) > _LIMIT:
                self._forget()
                new = np.ones(len(own), bool)
            which = one[new]
            text = low.tobytes()
            self._learn(own[new], [text[4 * x : 4 * y].decode("utf-32-le") for x, y in zip(a[which].tolist(), b[which].tolist(), strict=True)])
        at = np.searchsorted(self.hash, own)
        out = np.empty(len(h), np.int64)
        out[order] = np.repeat(at, np.diff(np.append(edge, len(h))))
        return out


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file (None: the public word-level one)."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def documents_ids(column: pa.Array, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text column, each text closed with END_ID; a null is an empty text."""
    ids, first = encoder(path).ids(*K.utf8(column))
    docs = len(first) - 1
    out = np.full(len(ids) + docs, END_ID, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(docs), np.diff(first))] = ids
    return out, first + np.arange(docs + 1)
