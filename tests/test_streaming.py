import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillveil.functions import places
from quillveil.functions.places import Lexer, json_string_inert, string_inert
from quillveil.streaming import fragments, sessions

VALUES = {"[EMAIL_1]": "a@x.com", "[PERSON_2]": "Ann [x]"}


@settings(max_examples=200, deadline=None)
@given(st.text("[]EMAIL_1PRSON2 x", max_size=40), st.integers(1, 7))
def test_any_cut_gives_the_same_text(noise, size):
    text = noise + "[EMAIL_1]" + noise + "[PERSON_2][" + noise
    whole = fragments.Fragments(VALUES, strict=False)
    want = whole.push(text) + whole.finish()
    cut = fragments.Fragments(VALUES, strict=False)
    assert "".join(cut.push(text[i : i + size]) for i in range(0, len(text), size)) + cut.finish() == want


def test_strict_refuses_unknown_tokens():
    with pytest.raises(ValueError, match="stream_unrestorable"):
        fragments.Fragments({}).push("x [EMAIL_9] y")


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_framing(size, end):
    raw = ("﻿: hi{0}event: a{0}data: 1{0}data:2{0}{0}{0}data: é{0}{0}").format(end).encode() + b"id: 3\n\n"
    f = fragments.Framer()
    got = [e for i in range(0, len(raw), size) for e in f.push(raw[i : i + size])]
    assert got == [{"name": "a", "data": "1\n2", "other": [": hi"]}, {"name": None, "data": "é", "other": []}, {"name": None, "data": None, "other": ["id: 3"]}]


def run(spark, df_rows, schema, tmp_path, build, order, want=3):
    for i, rows in enumerate(df_rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").start()
    until = time.time() + 120  # state with a time-out keeps a query busy, so it never runs out of work
    while spark.table(name).count() < want and q.isActive and time.time() < until:
        time.sleep(0.5)
    q.stop()
    return spark.table(name).orderBy(*order).collect()


def test_fragments_out_of_order(spark, tmp_path):
    v = {"[EMAIL_1]": "a@x.com"}
    batches = [[("s", 1, "MAIL_1] you", True, v), ("t", 0, "[EMAIL_7]", True, v)], [("s", 0, "hello [E", False, v), ("s", 0, "hello [E", False, v)]]
    rows = run(spark, batches, "stream_id string, seq long, chunk string, last boolean, values map<string,string>", tmp_path, fragments.restore_stream, ["stream_id", "seq"])
    assert [tuple(r) for r in rows] == [("s", 0, "hello ", None), ("s", 1, "a@x.com you", None), ("t", 0, None, "stream_unrestorable")]


def test_turns_share_a_mapping(spark, tmp_path):
    batches = [[("s", 1, "again a@x.com")], [("s", 0, "a@x.com and b@x.com"), ("u", 0, "b@x.com")]]
    rows = run(spark, batches, "session string, turn long, text string", tmp_path, sessions.mask_stream, ["session", "turn"])
    assert [(r["session"], r["turn"], r["text"]) for r in rows] == [("s", 0, "[EMAIL_1] and [EMAIL_2]"), ("s", 1, "again [EMAIL_1]"), ("u", 0, "[EMAIL_1]")]


def test_lost_turns_are_given_up(spark, tmp_path):
    ahead = [("s", n, f"a{n}@x.com") for n in range(5, 5 + fragments.MOST_WAITING + 1)] + [("s", 0, "a5@x.com")]
    rows = run(spark, [ahead, [("s", 2, "late")]], "session string, turn long, text string", tmp_path, sessions.mask_stream, ["session", "turn"], want=3 + fragments.MOST_WAITING)
    assert [tuple(r) for r in rows[:4]] == [("s", 0, "[EMAIL_1]", "completed", None), ("s", 1, None, "refused", "turn_missing"), ("s", 5, "[EMAIL_1]", "completed", None), ("s", 6, "[EMAIL_2]", "completed", None)]
    assert len(rows) == 3 + fragments.MOST_WAITING


def test_waiting_turns_of_an_idle_session_come_out(spark, tmp_path):
    rows = run(spark, [[("s", 1, "a@x.com"), ("s", 4, "b@x.com and a@x.com")]], "session string, turn long, text string", tmp_path, lambda t: sessions.mask_stream(t, idle_seconds=1), ["session", "turn"], want=4)
    assert [(r["turn"], r["text"], r["error_class"]) for r in rows] == [(0, None, "turn_missing"), (1, "[EMAIL_1]", None), (2, None, "turn_missing"), (4, "[EMAIL_2] and [EMAIL_1]", None)]


@pytest.mark.parametrize(
    ("client_format", "text", "place", "good", "bad"),
    [
        (None, "say ", "prose", 'any "thing" {', None),
        ("json", "", "prose", "a@b/c", "a//b"),
        (None, '{"a": "', "text", "it's", 'a"b'),
        (None, "{'a': '", "text", 'say "x"', "it's"),
        (None, "{a: ", "bare", "Ann-1.5", "a@b"),
        ("json5", "{a: ", "bare", "a@b & c", "a/*b"),
        (None, "use `", "ticked", "Ann", "a@b"),
        ("markdown", "use `", "ticked", "a@b (x)", "a`b"),
        ("jsonc", "{ // note ", "comment", "a@b", "x\ny"),
        (None, '{"a\n', "poisoned", "Ann", "a@b"),
        (None, "[" * 40, "poisoned", "Ann", "a_b"),
        (None, '{"a": "x\\"', "text", "y", "\\"),
        (None, '{"a": [1]} then ', "prose", "{", None),
    ],
)
def test_places(client_format, text, place, good, bad):
    lexer = Lexer(client_format)
    lexer.feed(text)
    assert lexer.place == place and lexer.safe(good) and (bad is None or not lexer.safe(bad))


def test_unsafe_values_are_refused():
    values = {"[PERSON_1]": 'A "B"'}
    strict = fragments.Fragments(values, lexer=Lexer())
    with pytest.raises(ValueError, match="stream_unsafe_place"):
        strict.push('{"name": "[PERSON_1]"}')
    lenient = fragments.Fragments(values, strict=False, lexer=Lexer())
    assert lenient.push('{"name": "[PERSON_1]"} [PERSON_1]') == '{"name": "[PERSON_1]"} A "B"'


def test_native_predicate(spark):
    values = ["ok", 'a"b', "a\\b", "a\tb", "a\u2028b", "é"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(string_inert(F.col("v"))).collect()]
    assert got == [json_string_inert(v) for v in values]


def test_native_predicates_of_bare_places(spark):
    values = ["Ann-1.5", "a@b & c/d", "a//b", "/a", "a/", "a_b", "é日 1", "a*b", "", "a,b", "x\ny"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(places.plain_column(F.col("v")), places.bare_inert(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(places.plain(v), places.json_bare_inert(v)) for v in values]


def test_state_of_streams_is_bounded(spark, tmp_path):
    v = {"[EMAIL_1]": "a@x.com"}
    ahead = [("s", n, "x", False, v) for n in range(1, 300)] + [("t", 0, "[EMAIL_1]", True, v), ("t", 1, "late", False, v), ("u", 0, '{"a": [EMAIL_1]}', True, v)]
    rows = run(spark, [ahead], "stream_id string, seq long, chunk string, last boolean, values map<string,string>", tmp_path, fragments.restore_stream, ["stream_id", "seq"])
    assert [tuple(r) for r in rows] == [("s", 0, None, "stream_oversized"), ("t", 0, "a@x.com", None), ("u", 0, None, "stream_unsafe_place")]
