"""Quality rules: word statistics and repeated passages found with a suffix array.

For every text a suffix array over its words is built by prefix doubling; ranks are kept for each
doubled length, so that neighbours' longest common prefixes are read off them.  A word belongs to a
maximal repeated substring of at least ``min_words`` words exactly if it lies in
``[i, i + max(LCP left, LCP right))`` for a suffix i with that maximum at least ``min_words``; the
union of these spans is the covered part.  A text is rejected if repeats cover more than
``max_covered`` of its words or one repeat is longer than ``max_repeat`` words.

Everything happens row by row, with no shuffle; memory is bounded by the chunk, or by the longest text.
Null text: as if empty (no words, so base_failed).  Repeated rows: each is judged by itself.  Equal words are ties of the suffix array
that the rest of the suffixes decides.  An empty table gives an empty result; extra columns stay, unless they have the name of a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
FIELDS = [K.field(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")]
VERDICTS = [K.field(n, T.BooleanType()) for n in ("base_failed", "kept")]


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key as the number of smaller keys, and how many keys equal it."""
    order = np.argsort(key)
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(s)))
    rank, many = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    rank[order], many[order] = np.repeat(at, size), np.repeat(size, size)
    return rank, many


def suffix_ranks(word: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until all differ.

    word: a number for each word, never shared between texts; end: where the text of each word ends.
    Equal ranks at a level mean equal prefixes of that length, wholly inside the text.
    """
    n = len(word)
    rank, many = _dense(word)
    levels, k = [rank], 1
    active = np.flatnonzero(many > 1)
    while len(active):
        after = active + k
        follow = np.zeros(len(active), np.int64)  # the end of the text comes first
        ok = after < end[active]
        follow[ok] = rank[after[ok]] + 1
        old = rank[active]
        part, many = _dense(old * (n + 1) + follow)
        group, _ = _dense(old)
        rank = rank.copy()
        rank[active] = old + part - group
        levels.append(rank)
        active, k = active[many > 1], 2 * k
    return levels


def common_prefixes(levels: list[np.ndarray], p: np.ndarray, q: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length in words of the longest common prefix of suffixes p and q of the same text."""
    out = np.zeros(len(p), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        a, b = p + out, q + out
        ok = np.flatnonzero((a < end[p]) & (b < end[q]))
        out[ok] += np.where(rank[a[ok]] == rank[b[ok]], 1 << level, 0)
    return out


def _cover(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + length, -1)
    return np.cumsum(d[:-1]) > 0


def repeated_spans(levels: list[np.ndarray], end: np.ndarray, least: int) -> np.ndarray:
    """For each suffix the longest prefix of at least so many words that occurs elsewhere in its text, or 0."""
    n = len(end)
    out = np.zeros(n, np.int64)
    level = max(least.bit_length() - 1, 0)  # 2**level words at least are shared
    if level >= len(levels):
        return out
    shared = np.flatnonzero(np.bincount(levels[level], minlength=n)[levels[level]] > 1)
    order = shared[np.argsort(levels[-1][shared])]  # the suffix array, without suffixes that share too little
    p, q = order[:-1], order[1:]
    near = levels[level][p] == levels[level][q]
    p, q = p[near], q[near]
    lcp = common_prefixes(levels, p, q, end)
    np.maximum.at(out, p, lcp)
    np.maximum.at(out, q, lcp)
    out[out < least] = 0
    return out


def _duplicate_lines(buf: np.ndarray, off: np.ndarray, words: K.Words) -> np.ndarray:
    """Of each text, the \\n-split lines with a word that equal an earlier line."""
    docs = len(off) - 1
    cut = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([off[:-1], cut + 1]))
    doc = np.searchsorted(off, start, side="right") - 1  # a \n that ends a text has its line in the next range: empty
    end = np.minimum(np.append(start[1:], len(buf)), len(buf))
    end = np.where(np.isin(end - 1, cut), end - 1, end)
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[has], end[has], doc[has]
    if not len(start):
        return np.zeros(docs, np.int64)
    key = K.mix(K.range_hashes(buf, start, end, lower=False) + K.mix(doc.astype(K.U64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(doc[again], minlength=docs)


def measure(buf: np.ndarray, off: np.ndarray, min_words: int = 8) -> dict[str, np.ndarray]:
    """The counts of FIELDS for each text of a chunk."""
    w = K.find_words(buf, off)
    docs, n = len(off) - 1, len(w.start)
    points = K.code_points(buf)
    symbols = np.isin(buf, np.frombuffer(SYMBOLS.encode(), np.uint8))
    out = {
        "n_words": np.diff(w.first),
        "word_chars": K.sums(points[w.end] - points[w.start], w.first),
        "n_symbols": K.sums(symbols.astype(np.int64), off),
        "n_dup_lines": _duplicate_lines(buf, off, w),
    }
    if not n:
        return out | {k: np.zeros(docs, np.int64) for k in ("n_repeat_words", "covered_words", "longest_repeat")}
    doc = w.doc
    end = w.first[1:][doc]
    levels = suffix_ranks(K.mix(K.range_hashes(buf, w.start, w.end, lower=False) + K.mix(doc.astype(K.U64))), end)
    trigram = np.zeros(n, bool)
    if len(levels) > 1:
        two = levels[1]
        many = np.bincount(two, minlength=n)[two] > 1
        at = np.flatnonzero(many)
        at = at[at + 2 < end[at]]
        if len(at):
            _, same = _dense(two[at] * (n + 1) + two[at + 1])
            at = at[same > 1]
            trigram = _cover(n, at, np.full(len(at), 3))
    length = repeated_spans(levels, end, min_words)
    at = np.flatnonzero(length)
    covered = _cover(n, at, length[at]) if len(at) else np.zeros(n, bool)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc[at], length[at])
    return out | {"n_repeat_words": K.sums(trigram.astype(np.int64), w.first), "covered_words": K.sums(covered.astype(np.int64), w.first), "longest_repeat": longest}


def quality_rules(df: DataFrame, text: str = "text", keep: list[str] | None = None, min_words: int = 8, max_covered: float = 0.35, max_repeat: int = 200, least_words: int = 50) -> DataFrame:
    """The kept columns (all, unless named), the counts, base_failed and kept; extra columns of these names are replaced."""

    def kernel(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        x = measure(buf, off, min_words)
        failed = (x["n_words"] < least_words) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
        return x | {"base_failed": failed, "kept": ~failed & (x["covered_words"] <= max_covered * x["n_words"]) & (x["longest_repeat"] <= max_repeat)}

    return K.map_text(df, text, FIELDS + VERDICTS, kernel, df.columns if keep is None else keep)


def quality_filter(df: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The rows that quality_rules keeps, with the columns of df and their values."""
    mark = "__kept"
    while mark in df.columns:
        mark += "_"
    fields = [K.field(mark, T.BooleanType())]
    options = {"min_words": 8, "max_covered": 0.35, "max_repeat": 200, "least_words": 50} | rules

    def kernel(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        x = measure(buf, off, options["min_words"])
        failed = (x["n_words"] < options["least_words"]) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
        return {mark: ~failed & (x["covered_words"] <= options["max_covered"] * x["n_words"]) & (x["longest_repeat"] <= options["max_repeat"])}

    return K.map_text(df, text, fields, kernel, df.columns).where(F.col(mark)).drop(mark)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", *[f.name for f in FIELDS + VERDICTS])
