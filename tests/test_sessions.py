"""Sessions solved in parallel against turns taken one after another; matching against brute force."""

import pathlib
import random
import time
from itertools import permutations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillveil.operators import evaluation, sessions
from quillveil.operators.detection import Finder
from quillveil.plans import catalog

MAILS = ["b@example.com", "a.b@example.com", "x@example.org", "long.name@example.org", "name@example.org", "DE89 3704 0044 0532 0130 00", "q@example.net"]


def one_after_another(rows, most):
    find, mappings, out = Finder(), {}, []
    for s, n, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1])):
        mapping, masked, error = sessions.turn(mappings.get(s, sessions.Mapping(most)), text, find)
        mappings[s] = mapping
        out.append((s, n, masked, "refused" if error else "completed", error))
    return sorted(out, key=str)


def talk(seed, literals):
    rng, rows = random.Random(seed), []
    for s in ("hot", "b", "c", None):
        for n in range(60 if s == "hot" else 7):
            words = [rng.choice(["to", "hello", "über", "and", "\U0001f600"]) for _ in range(3)]
            words += rng.sample(MAILS, rng.randint(0, 3)) + (["b@example.com.au", "xb@example.com"] if rng.random() < 0.2 else [])
            if literals and rng.random() < 0.25:
                words.append(f"[{rng.choice(['EMAIL', 'IBAN'])}_{rng.randint(1, 9)}]")
            rng.shuffle(words)
            rows.append((s, n, None if rng.random() < 0.05 else " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "literals", "most"), [(1, False, 1000), (2, True, 1000), (3, False, 2), (4, True, 3), (5, True, 1)])
def test_sessions_in_parallel(spark, monkeypatch, seed, literals, most):
    monkeypatch.setattr(sessions, "TURNS_AT_ONCE", 8)
    rows = talk(seed, literals)
    df = spark.createDataFrame(rows, "session string, turn long, text string").repartition(3)
    got = sessions.mask_sessions(df, ["session"], ["turn"], most=most)
    assert got.columns == ["session", "turn", "text", "status", "error_class"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == one_after_another(rows, most)


def test_what_sessions_leave_on_disk(spark):
    place = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(place.glob("*"))
    rows = [("s", n, f"to u{n}@mail.example, ask u{n - 1}@mail.example") for n in range(1, 20)]
    out = sessions.mask_sessions(spark.createDataFrame(rows, "session string, turn long, text string"), ["session"], ["turn"])
    assert len(set(place.glob("*")) - before) == 2  # the turns and what is hidden in them
    assert {r["turn"]: r["text"] for r in out.collect()}[3] == "to [EMAIL_4], ask [EMAIL_3]"


def test_empty_table_of_turns(spark):
    assert sessions.mask_sessions(spark.createDataFrame([], "s string, n long, text string"), ["s"], ["n"]).count() == 0


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=6), st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_known_values_are_placed_longest_first(found, known):
    text = "x" * 60
    spans, at = [], 0
    for a, n in sorted(found):
        if a >= at:
            spans.append((a, a + n, "EMAIL"))
            at = a + n
    known = [(a, a + n) for a, n in known]
    expected = list(spans)
    for a, b in known:
        over = [s for s in expected if s[0] < b and a < s[1]]
        if all(a <= s[0] and s[1] <= b for s in over):
            expected = sorted([s for s in expected if s not in over] + [(a, b, None)], key=lambda s: s[0])
    assert sessions.placed(text, spans, known) == expected


def test_many_occurrences_take_linear_time():
    mapping = sessions.Mapping()
    mapping.token("ab", "EMAIL")
    began = time.thread_time()
    assert sessions.mask(mapping, "ab " * 200_000, []) == "[EMAIL_1] " * 200_000
    assert time.thread_time() - began < 10


@given(st.lists(st.lists(st.integers(0, 5), max_size=4, unique=True), max_size=5))
@settings(max_examples=300, deadline=None)
def test_matched(choices):
    best = 0
    for order in permutations(range(6), min(len(choices), 6)):
        best = max(best, sum(r in c for r, c in zip(order, choices, strict=False)))
    assert evaluation.matched(choices) == best


@given(*[st.lists(st.tuples(st.integers(0, 20), st.integers(0, 9)), max_size=8)] * 2)
@settings(max_examples=200, deadline=None)
def test_near(gold, predicted):
    gold, predicted = ([(a, a + n) for a, n in side] for side in (gold, predicted))
    expected = [{i for i, (x, y) in enumerate(predicted) if min(b, y) > max(a, x) and 2 * (min(b, y) - max(a, x)) >= max(b, y) - min(a, x)} for a, b in gold]
    assert [set(r) for r in evaluation.near(gold, predicted)] == expected


def test_chain_of_spans(spark):
    gold = spark.range(100_000).select(F.lit("t").alias("k"), F.lit("PERSON").alias("entity_type"), (F.col("id") * 2).alias("start"), (F.col("id") * 2 + 3).alias("end"))
    predicted = gold.select("k", "entity_type", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"))
    assert tuple(evaluation.match_counts(gold, predicted, ["k"]).first())[2:] == (100_000, 0, 0)
    backwards = [[i, i + 1] if i % 7 else [i + 1, i] for i in range(50_000)]
    assert evaluation.matched([*backwards[::-1], [0]]) == 50_001


@pytest.mark.parametrize("query", ["masked_bodies", "session_recurrence"])
def test_sessions_of_more_values_than_are_usually_kept(spark, tmp_path, query):
    """1,050 values in each of twenty sessions, compared with the query's SQL."""
    spark.range(21_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.sql(f"create view customer as from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.sql(catalog.SQL[query]).fetchall()
    got = catalog.QUERIES[query](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_known_words_are_those_of_the_automaton():
    pick = random.Random(1)
    for _ in range(2000):
        text = "".join(pick.choice("ab .ü[²") for _ in range(pick.randrange(14)))
        values = {"".join(pick.choice("ab .ü²") for _ in range(pick.randrange(1, 5))) for _ in range(pick.randrange(9))}
        assert sessions.known_words(text, values, {len(v) for v in values}) == list(sessions.whole_words(text, sessions.occurrences(sessions.automaton(values), text)))


def test_a_failed_turn_is_taken_back():
    mapping = sessions.Mapping()
    sessions.turn(mapping, "a@x.com", Finder())
    before = mapping.dump()
    with pytest.raises(sessions.Refused), mapping.attempt():
        mapping.reserve("[EMAIL_7]")
        mapping.token("b@x.com", "EMAIL")
        mapping.reserve("[EMAIL_1]")
    assert mapping.dump() == before and mapping.lengths == {7: 1}
