"""Running totals by ranges, interval joins, islands and numbering against plain Python, on keys that hold most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillveil.operators import pseudonyms, resolution, scans


def spans_of(seed, n, keys, longest):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = int(rng.integers(-50, 4000))
        rows.append((None if (k := int(rng.integers(0, keys)) if rng.random() < 0.3 else 0) == 3 else k, a, a + int(longest ** rng.random()), i))
    return rows


def test_running(spark):
    rows = [(k, i, (i * 37) % 11) for i in range(400) for k in ([0] if i % 5 else [0, i % 3, None])]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(3)
    cut = scans.Ranges(df.withColumn("u", F.monotonically_increasing_id()), ["k"], ["i", "u"])
    for fold, plain in ((F.sum, sum), (F.max, max)):
        for current in (True, False):
            got = cut.running(cut.rows, "t", fold, F.col("v"), current).orderBy("k", "i", "u").collect()
            seen = {}
            for r in got:
                before = seen.setdefault(r.k, [])
                values = [*before, r.v] if current else before
                assert (r.t or 0) == (plain(values) if values else 0)
                before.append(r.v)


@pytest.mark.parametrize("one_window", [0, 1 << 20])
def test_islands(spark, one_window):
    rows = spans_of(1, 900, 5, 60) + [(0, 7, 7, 1000), (0, 9000, 9000, 1001), (4, 9000, 9001, 1002), (4, 9000, 9000, 1003)]
    df = spark.createDataFrame(rows, "k long, start long, end long, id long").repartition(5)
    expected = []
    for k in {r[0] for r in rows}:
        own = sorted((a, b) for kk, a, b, _ in rows if kk == k)
        line = []
        for a, b in own:
            if line and a < line[-1][1]:
                line[-1] = [line[-1][0], max(b, line[-1][1]), line[-1][2] + 1]
            elif line and line[-1][0] == a:  # empty spans are known by their start, like what begins there
                line[-1] = [a, max(b, line[-1][1]), line[-1][2] + 1]
            else:
                line.append([a, b, 1])
        expected += [(k, *x) for x in line]
    got = resolution.islands(df, ["k"], one_window=one_window).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


@pytest.mark.parametrize("longest", [2, 40, 5000])
def test_pairs(spark, longest):
    rows = spans_of(longest, 350, 5, longest) + [(0, a, a, 1000 + a) for a in range(0, 4000, 90)]
    df = spark.createDataFrame(rows, "k long, start long, end long, id long")
    expected = {}
    for k, a, b, i in rows:
        for k2, a2, b2, j in rows:
            if k == k2 and i < j and a < b2 and a2 < b:
                holds, inside = a <= a2 and b2 <= b, a2 <= a and b <= b2
                expected[i, j] = "same" if holds and inside else "a holds b" if holds else "b holds a" if inside else "overlap"
    got = resolution.pairs(df, ["k"]).collect()
    assert {(r.a, r.b): r.relation for r in got} == expected and len(got) == len(expected)


def test_two_tables_overlap(spark):
    rows = spans_of(9, 500, 4, 300)
    left, right = rows[:200], rows[200:]
    a, b = (spark.createDataFrame(x, "k long, start long, end long, id long").select("k", F.struct("start", "end", "id").alias("span")) for x in (left, right))
    got = resolution.overlapping(a, b, ["k"]).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).unionByName(resolution.overlapping(b, a, ["k"], finer_only=True).select(F.col("b.id").alias("x"), F.col("a.id").alias("y")))
    expected = sorted((i, j) for k, s, e, i in left for k2, s2, e2, j in right if k == k2 and max(s, s2) < min(e, e2))
    assert sorted(map(tuple, got.collect())) == expected


def test_pairs_of_one_long_text(spark):
    """Joined rows follow the result, not the square of the spans."""
    spans = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 5 + F.when(F.col("id") % 1000 == 0, 500).otherwise(0)).alias("end"), "id")
    assert resolution.pairs(spans, ["k"]).where("b = a + 1").count() == 99_999


def plain_numbers(kinds, reserved):
    out, at = [], 0
    for kind in kinds:
        at += 1
        while f"[{kind}_{at}]" in reserved:
            at += 1
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_numbers_step_over_literals(spark, seed):
    rng = np.random.default_rng(seed)
    kinds = ["EMAIL", "PERSON", "IBAN"]
    sessions = {s: [kinds[int(x)] for x in rng.integers(0, 3, int(n))] for s, n in (("hot", 300), ("b", 12), (None, 40), ("c", 1))}
    literals = {s: {f"[{kinds[int(rng.integers(0, 3))]}_{int(rng.integers(1, 60))}]" for _ in range(n)} for s, n in (("hot", 50), (None, 25), ("c", 3))}
    literals["hot"] |= {"[EMAIL_01]", "[EMAIL_99999999999999]", "[PERSON_0]"}
    values = spark.createDataFrame([(s, f"v{i}", k, i) for s, ks in sessions.items() for i, k in enumerate(ks)], "s string, value string, entity_type string, first long").repartition(4)
    wrote = spark.createDataFrame([(s, t) for s, ts in literals.items() for t in ts], "s string, token string")
    got = {}
    for r in pseudonyms.number(values, ["s"], wrote).orderBy("first").collect():
        got.setdefault(r.s, []).append(r.n)
        assert r.placeholder == f"[{r.entity_type}_{r.n}]"
    assert got == {s: plain_numbers(ks, literals.get(s, set())) for s, ks in sessions.items()}
    one = pseudonyms.number(values.where("s = 'hot'").drop("s"), [], wrote.where("s = 'hot'").drop("s")).orderBy("first").collect()
    assert [r.n for r in one] == got["hot"]


def test_columns_may_have_any_name(spark):
    df = spark.createDataFrame([("x", 1, "write to a.b@example.com"), ("x", 2, "to a.b@example.com or c@example.org"), (None, 3, "c@example.org [EMAIL_1]")], "s string, value long, text string")
    for session, position in ((["s"], ["value"]), (["value"], ["s"]), ([], ["value", "s"])):
        masked, mapping = pseudonyms.pseudonymize(df, session, position)
        assert masked.columns == df.columns
        back = pseudonyms.restore(masked, mapping, session, written=df.select(*session, F.lit("[EMAIL_1]").alias("token")).where(F.lit(bool(session and session[0] == "s"))).where("s is null") if session == ["s"] else None)
        if session == ["s"]:
            assert sorted(r.text for r in back.collect()) == sorted(r.text for r in df.collect())
    renamed = df.toDF("first", "n", "text")
    masked, mapping = pseudonyms.pseudonymize(renamed, ["first"], ["n"])
    assert mapping.columns == ["first", "value", "entity_type", "first_", "n", "placeholder"] and masked.where("first = 'x'").count() == 2
    assert {r.text for r in pseudonyms.restore(masked.where("first = 'x'"), mapping, ["first"]).collect()} == {r.text for r in df.where("s = 'x'").collect()}
