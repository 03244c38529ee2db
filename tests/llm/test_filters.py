"""The audit of filters against plain Python and its SQL."""

import re
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillveil.llm import filters, queries


def plain_masks(rows):
    """The set of failed filters of each (part, id, text)."""
    smallest = {}
    for _, doc, text in rows:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    out = []
    for _, doc, text in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc is not None and smallest[t] < doc}
        out.append({f for f, x in fails.items() if x})
    return out


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    parts = defaultdict(list)
    for (part, doc, _), mask in zip(rows, plain_masks(rows), strict=True):
        parts[part or ""].append((doc, mask))
    out = []
    for part, docs in parts.items():
        removed_in = defaultdict(int)
        mine = []
        for order in filters.ORDERS:
            left = docs
            for step, f in enumerate(order, 1):
                gone = [(d, m) for d, m in left if f in m]
                left = [(d, m) for d, m in left if f not in m]
                removed_in[f] += len(gone)
                mine.append([part, order, step, len(left), len(gone), sum(f in m for _, m in docs) - len(gone), sum(m == {f} for _, m in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)])
        out += [(*r, removed_in[r[1][r[2] - 1]]) for r in mine]
    return sorted(out)


@given(st.text("aB# \t\n", max_size=50))
@settings(max_examples=100, deadline=None)
def test_word_counts(text):
    before = filters._PIECE
    filters._PIECE = 7
    try:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert filters.word_counts(text) == (len(words), len(set(words)))
    finally:
        filters._PIECE = before


def table_rows():
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "a b", "A B C", long, long + " #", "x " * 300, "X " * 300, long, "a\nb", "a b", "é中 $"]
    rows = [(("s", "t", None, "")[i % 4], i % 37, texts[i * 7 % len(texts)]) for i in range(150)]
    return rows + [("t", None, long), (None, None, ""), ("hot", 5, long), ("hot", 5, long)] + [("hot", i, "the same") for i in range(100, 160)]


@pytest.mark.parametrize("colliding", [False, True])
@pytest.mark.parametrize("block", [10, 1 << 24])
def test_masks(spark, monkeypatch, colliding, block):
    rows = table_rows()
    monkeypatch.setattr(filters, "BLOCK_CHARS", block)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "source string, doc_id long, text string, mask string").repartition(5)
    got = filters.filter_masks(df, key_of=(lambda text: len(text) % 2) if colliding else filters._text_key)
    expected = defaultdict(int)
    for (part, doc, _), mask in zip(rows, plain_masks(rows), strict=True):
        expected[doc, part or "", sum(1 << filters.FILTERS.index(f) for f in mask)] += 1
    found = defaultdict(int)
    for r in got.collect():
        found[r.doc, r.part, r.mask] += r.n
    assert found == expected


def test_audit(spark):
    rows = table_rows()
    labels = [(i, i % 2, i % 3 == 0 or None) for i in range(0, 160, 2)] + [(4, 1, 0), (None, 1, 1)]
    labels = [(d, q, None if x is None else int(x)) for d, q, x in labels]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "source string, doc_id long, text string, kept string")
    got = filters.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, labels)


def test_very_long_text(spark):
    rows = [("s", 1, "word " * 600_000), ("s", 2, "word " * 600_000), ("s", 3, "X" * 3_000_000)]
    got = filters.filter_masks(spark.createDataFrame(rows, "source string, doc_id long, text string"))
    assert sorted((r.doc, r.mask) for r in got.collect()) == [(1, 2), (2, 18), (3, 5)]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "source string, doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.filter_audit(docs, labels).count() == 0
    one = filters.filter_audit(spark.createDataFrame([("s", 1, "a")], docs.schema), labels)
    assert one.count() == 600 and {r.kept for r in one.where("step = 5").collect()} == {0}


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    expected = con.execute(f"select {', '.join(columns)} from ({queries.SQL['op12_filter_audit']})").fetchall()
    got = filters.op12_filter_audit(spark, sf)
    assert got.columns == columns and sorted(tuple(r) for r in got.collect()) == sorted(expected)
