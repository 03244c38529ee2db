import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillveil.operators import resolution
from quillveil.operators.spans import Span

SPECIFICITY = {"A": 90, "B": 40, "C": 40, "D": 10}
SPANS = st.lists(
    st.builds(lambda t, a, n, c, r, k: Span(t, a, a + n, 1.0 if r == "catalog:x" and c > 0.7 else min(c, 0.99), r, k), st.sampled_from("ABCD"), st.integers(0, 25), st.integers(1, 10), st.sampled_from([0.3, 0.5, 0.8]), st.sampled_from(["catalog:x", "ner"]), st.integers(1, 3)),
    max_size=9,
)


@settings(max_examples=300, deadline=None)
@given(SPANS)
def test_never_narrows_and_never_overlaps(spans):
    trace = []
    out = resolution.settle(spans, SPECIFICITY, trace=trace)
    assert all(a.end <= b.start for a, b in zip(out, out[1:], strict=False))
    covered = {i for s in spans for i in range(s.start, s.end)}
    assert covered == {i for s in out for i in range(s.start, s.end)}
    assert resolution.settle(out, SPECIFICITY) == out
    shuffled = list(spans)
    random.Random(1).shuffle(shuffled)
    assert resolution.settle(shuffled, SPECIFICITY) == out


def s(kind, a, b, c=0.5, r="ner", tier=2):
    return Span(kind, a, b, c, r, tier)


def rule(a, b, untouchable=resolution.checksummed):
    trace = []
    out = resolution.settle([a, b], SPECIFICITY, untouchable, trace)
    return out, trace[0].rule


def test_rules():
    assert rule(s("A", 0, 5), s("A", 3, 9, 0.8)) == ([s("A", 0, 9, 0.8)], "same-type-merge")
    assert rule(s("D", 0, 9), s("B", 2, 4, 1.0, "catalog:x", 1)) == ([s("B", 0, 9, 1.0, "catalog:x", 1)], "untouchable-inner-merge")
    assert rule(s("D", 0, 9), s("A", 2, 4)) == ([s("A", 0, 9)], "specific-inner-merge")
    assert rule(s("B", 0, 9, 1.0, "catalog:x"), s("A", 2, 4, 1.0, "catalog:y"))[1] == "nested-specificity-merge"
    assert rule(s("B", 0, 9, 1.0, "catalog:x", 2), s("C", 2, 4, 1.0, "catalog:y", 1))[1] == "nested-sensitivity-merge"
    assert rule(s("B", 0, 9, 0.5), s("C", 2, 4, 0.6), lambda _: True)[1] == "nested-confidence-merge"
    assert rule(s("A", 0, 9), s("D", 2, 4)) == ([s("A", 0, 9)], "nesting-outer-wins")
    assert rule(s("B", 0, 5, 1.0, "catalog:x"), s("A", 3, 9)) == ([s("B", 0, 9, 1.0, "catalog:x")], "untouchable-wins")
    assert rule(s("D", 0, 5), s("A", 3, 9)) == ([s("A", 0, 9)], "specificity")
    assert rule(s("B", 0, 5, 0.6), s("C", 3, 9, 0.5)) == ([s("B", 0, 9, 0.6)], "confidence")
    assert rule(s("B", 0, 5, tier=3), s("C", 3, 9, tier=2)) == ([s("C", 0, 9)], "tie-merge-sensitive")
    assert resolution.settle([s("A", 0, 5), s("B", 5, 9)], {}) == [s("A", 0, 5), s("B", 5, 9)]


def test_islands_are_the_resolved_extents(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for doc in range(60):
        spans = [s(rng.choice("ABCD"), a := rng.randrange(40), a + rng.randrange(1, 9)) for _ in range(rng.randrange(1, 9))]
        rows += [(doc, x.start, x.end) for x in spans]
        want |= {(doc, x.start, x.end) for x in resolution.settle(spans, SPECIFICITY)}
    got = resolution.islands(spark.createDataFrame(rows, "doc long, start int, end int"), ["doc"])
    assert {(r["doc"], r["start"], r["end"]) for r in got.collect()} == want


@pytest.mark.parametrize(("longest", "at_once", "few"), [(9, 40, 16), (300, 25, 4096), (300, 1 << 17, 64)])
def test_relations_are_counted_as_pairs_are(spark, monkeypatch, longest, at_once, few):
    monkeypatch.setattr(resolution, "SPANS_AT_ONCE", at_once)
    monkeypatch.setattr(resolution, "FEW_PAIRS", few)
    rng, rows = random.Random(longest + at_once), []
    for k, n in ((None, 120), ("a", 90), ("b", 7), ("c", 1)):
        for i in range(n):
            start = rng.randrange(150)
            rows.append((k, start if i != 5 else None, start + rng.randrange(rng.choice([3, longest])), rng.choice([i, i // 2, rng.randrange(500)]) if i != 6 else None))
    df = spark.createDataFrame(rows, "k string, start long, end long, id long")
    want = resolution.pairs(df, ["k"]).groupBy("k", "relation").agg(F.count("*").alias("pairs"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    got = resolution.relation_counts(df, ["k"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_pairs_beyond_any_number_that_could_be_listed(spark):
    n = 60_000
    df = spark.range(n).select(F.lit(0).alias("start"), (F.col("id") + 1).alias("end"), (n - F.col("id")).alias("id"))
    (row,) = resolution.relation_counts(df, []).collect()
    assert (row["relation"], row["pairs"], row["a"]) == ("a holds b", n * (n - 1) // 2, sum(i * (n - i) for i in range(1, n + 1)))
