import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillveil.llm import repetition, textkit
from quillveil.llm import tokens as tokenizing

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té*#", max_size=40)), min_size=1, max_size=6)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    buf, off = textkit.utf8(pa.array(texts, pa.string()))
    w = textkit.find_words(buf, off)
    data = buf.tobytes()
    got = [[data[w.start[k] : w.end[k]].decode() for k in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    if len(buf):
        h = textkit.range_hashes(buf, w.start, w.end)
        flat = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for t in got for x in t]
        assert len(set(h.tolist())) == len(set(flat))


def test_hashes_do_not_depend_on_place():
    buf, off = textkit.utf8(pa.array(["one two", "xx two one"]))
    w = textkit.find_words(buf, off)
    h = textkit.range_hashes(buf, w.start, w.end)
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_hashes_of_crafted_texts_differ():
    thue = "a"
    for _ in range(10):  # the words on which polynomial hashes modulo a power of two collide
        thue += thue.translate(str.maketrans("ab", "ba"))
    words = [thue, thue.translate(str.maketrans("ab", "ba")), "a" * 8, "a" * 16, "a" * 7 + "\0", "abcdefgh12345678", "12345678abcdefgh", "a\0", "a"]
    buf, off = textkit.utf8(pa.array(words))
    assert len(set(textkit.range_hashes(buf, off[:-1], off[1:]).tolist())) == len(words)


def test_slices_cover_all_rows_and_long_texts_stand_alone():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 50, 1, 1, 0)] + [None])], names=["t"])
    parts = list(textkit.slices(b, "t", 10))
    assert [p.num_rows for p in parts] == [1, 1, 4]
    assert list(textkit.slices(b.slice(0, 0), "t")) == []


def brute(text, least):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)

    def repeated(k):
        at = {}
        for i in range(len(w) - k + 1):
            at.setdefault(tuple(w[i : i + k]), []).append(i)
        return [i for v in at.values() if len(v) > 1 for i in v]

    three = {j for i in repeated(3) for j in range(i, i + 3)}
    covered, longest, k = set(), 0, least
    while at := repeated(k):
        covered |= {j for i in at for j in range(i, i + k)}
        longest, k = k, k + 1
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(three), len(covered), longest]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_repetition_equals_brute_force(texts):
    x = repetition.measure(*textkit.utf8(pa.array(texts, pa.string())), 4)
    for d, t in enumerate(texts):
        assert [int(x[f.name][d]) for f in repetition.FIELDS] == brute(t, 4)


def test_repetition_of_long_runs():
    text = " ".join(["a"] * 500) + "\n" + " ".join(f"w{i}" for i in range(300)) * 2
    x = repetition.measure(*textkit.utf8(pa.array([text, None, ""])), 8)
    assert x["longest_repeat"][0] == 499 and x["n_words"].tolist()[1:] == [0, 0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB'stmdrevl 1.É\"_é\n²İΣ日\x1c", max_size=30), min_size=1, max_size=5))
def test_tokens_are_those_of_the_library(texts):
    e = tokenizing.encoder()
    ids, first = e.ids(*textkit.utf8(pa.array(texts, pa.string())))
    for d, want in enumerate(e.whole(texts)):
        assert np.array_equal(ids[first[d] : first[d + 1]], want)


def test_tokens_after_forgetting(monkeypatch):
    monkeypatch.setattr(tokenizing, "_LIMIT", 5)
    e = tokenizing.Encoder()
    texts = ["one two three four", "five six seven eight nine ten", "one ten"]
    for t in texts:
        ids, _ = e.ids(*textkit.utf8(pa.array([t])))
        assert np.array_equal(ids, e.whole([t])[0])
