import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillveil.operators import audit, jsontext, pseudonyms, sessions
from quillveil.operators.detection import Finder

ROWS = [
    ("s1", 0, "write to a@x.com or b@y.org"),
    ("s1", 1, "b@y.org again, card 4785380592391139"),
    ("s2", 0, "[EMAIL_1] is taken, c@z.net [CREDIT_CARD_9]"),
    ("s2", 1, None),
    ("s3", 0, "nothing"),
]


@pytest.fixture
def turns(spark):
    return spark.createDataFrame(ROWS, "session string, turn long, text string")


def test_pseudonymize_and_restore(spark, turns):
    masked, mapping = pseudonyms.pseudonymize(turns, ["session"], ["turn"])
    got = {(r["session"], r["turn"]): r["text"] for r in masked.collect()}
    assert got["s1", 0] == "write to [EMAIL_1] or [EMAIL_2]"
    assert got["s1", 1] == "[EMAIL_2] again, card [CREDIT_CARD_3]"
    assert got["s2", 0] == "[EMAIL_1] is taken, [EMAIL_2] [CREDIT_CARD_9]"
    assert got["s2", 1] is None and got["s3", 0] == "nothing"
    written = pseudonyms.written_tokens(turns, ["session"])
    back = pseudonyms.restore(masked, mapping, ["session"], ["turn"], written=written)
    assert {(r["session"], r["turn"], r["text"]) for r in back.collect()} == set(ROWS)
    strange = spark.createDataFrame([("s1", 5, "[EMAIL_1] and [PERSON_7]")], "session string, turn long, text string")
    strict = pseudonyms.restore(strange, mapping, ["session"], ["turn"]).first()
    assert (strict["text"], strict["status"], strict["error_class"]) == (None, "refused", "mapping_unknown_placeholder")
    assert pseudonyms.restore(strange, mapping, ["session"], ["turn"], strict=False).first()["text"] == "a@x.com and [PERSON_7]"


def test_null_keys_and_equal_positions(spark):
    """No row is left in clear, and none gets another's pieces."""
    rows = [(None, 0, "mail b@x.com now"), ("s", None, "mail b@x.com now"), ("s", 1, "first a@x.com"), ("s", 1, "second c@x.com text"), ("s", 1, "second c@x.com text"), (None, None, None)]
    df = spark.createDataFrame(rows, "session string, turn long, text string").withColumn("__row", F.lit("clash"))
    masked, mapping = pseudonyms.pseudonymize(df, ["session"], ["turn"])
    texts = [r["text"] for r in masked.collect()]
    assert masked.columns == df.columns and sum(t is None for t in texts) == 1 and not any("@" in t for t in texts if t)
    assert sorted(re.sub(r"\d", "#", t) for t in texts if t) == ["first [EMAIL_#]", "mail [EMAIL_#] now", "mail [EMAIL_#] now", "second [EMAIL_#] text", "second [EMAIL_#] text"]
    assert {(r["session"], r["n"]) for r in mapping.collect()} == {(None, 1), ("s", 1), ("s", 2), ("s", 3)}
    back = pseudonyms.restore(masked, mapping, ["session"])
    assert sorted(((r["session"], r["turn"], r["text"]) for r in back.collect()), key=str) == sorted(rows, key=str)
    strange = pseudonyms.restore(spark.createDataFrame([(None, "[EMAIL_7]")], "session string, text string"), mapping, ["session"]).first()
    assert strange["status"] == "refused"
    for literals in (True, False):
        masked, mapping = pseudonyms.pseudonymize(df, [], ["turn"], literals=literals)
        assert {r["n"] for r in mapping.collect()} == {1, 2, 3}
        assert sorted(str(r["text"]) for r in pseudonyms.restore(masked, mapping, []).collect()) == sorted(str(t) for _, _, t in rows)


def test_numbers_of_one_large_session(spark):
    found = spark.range(5000).select(F.lit("s").alias("session"), (F.col("id") * 7919 % 5000).alias("at"), F.concat(F.lit("v"), F.col("id") * 7919 % 5000).alias("value"), F.lit("ORG").alias("entity_type"))
    values = pseudonyms.first_values(found, ["session"], ["at"])
    got = pseudonyms.number(values, ["session"]).collect()
    assert all(r["value"] == f"v{r['n'] - 1}" for r in got) and len(got) == 5000
    literals = spark.createDataFrame([("s", "[ORG_3]"), ("s", "[ORG_4]"), ("s", "[PERSON_9]")], "session string, token string")
    shifted = {r["value"]: r["n"] for r in pseudonyms.number(values, ["session"], literals).collect()}
    assert [shifted[f"v{i}"] for i in (0, 1, 2, 4999)] == [1, 2, 5, 5002]


def test_first_type_names_a_value_and_unknown_types_fall_back(spark):
    found = spark.createDataFrame([("s", 1, "v", "PERSON"), ("s", 0, "v", "ORG"), ("s", 2, "w", "NONSENSE")], "session string, at int, value string, entity_type string")
    rows = pseudonyms.number(pseudonyms.first_values(found, ["session"], ["at"]), ["session"]).orderBy("n").collect()
    assert [r["placeholder"] for r in rows] == ["[ORG_1]", "[REDACTED_2]"]


def test_sessions_hide_known_values_and_keep_the_earliest(turns):
    rows = sessions.mask_sessions(turns, ["session"], ["turn"]).collect()
    got = {(r["session"], r["turn"]): (r["text"], r["status"]) for r in rows}
    assert got["s1", 1] == ("[EMAIL_2] again, card [CREDIT_CARD_3]", "completed") and got["s2", 0][0].startswith("[EMAIL_1] is taken, [EMAIL_2]")
    m, find = sessions.Mapping(2), Finder()
    m, text, _ = sessions.turn(m, "a@x.com b@x.com c@x.com", find)
    assert text == "[EMAIL_1] [EMAIL_2] [EMAIL_3]" and list(m.tokens) == ["a@x.com", "b@x.com"]
    m, text, _ = sessions.turn(m, "c@x.com (a@x.com)", find)
    assert text == "[EMAIL_4] ([EMAIL_1])"
    same, text, error = sessions.turn(m, "give me [EMAIL_1]", find)
    assert error == "mapping_literal_already_issued" and text is None and same is m


def test_known_values_displace_what_they_contain():
    m = sessions.Mapping()
    m.token("Jean Dupont", "PERSON")
    assert sessions.mask(m, "Jean Dupont, Dupont", [(5, 11, "ORG")]) == "[PERSON_1], Dupont"
    assert sessions.mask(m, "xJean Dupont Jean Duponty", []) == "xJean Dupont Jean Duponty"
    with pytest.raises(sessions.Refused):
        sessions.placed("abc", [(0, 2, "A"), (1, 3, "B")], [])


def test_overlapping_known_values():
    m = sessions.Mapping()
    for value in ("Anna Maria", "Maria Berg Holm", "Berg"):
        m.token(value, "PERSON")
    assert sessions.mask(m, "Anna Maria Berg Holm", []) == "Anna [PERSON_2]"
    assert sessions.mask(m, "Anna Maria Berg Holm", [(11, 20, "ORG")]) == "Anna [PERSON_2]"
    assert sessions.mask(m, "Maria Berg Holm, Inc", [(11, 20, "ORG")]).startswith("Maria [PERSON_3] [")


def test_json_leaves_and_limits(spark):
    root = jsontext.parse('{"a": [1.10, "x", null, true, {"b": "y"}], "a": "z", "n": 1e400}')
    assert jsontext.leaves(root) == [("a", "number", "1.10"), ("a", "string", "x"), ("b", "string", "y"), ("a", "string", "z"), ("n", "number", "1e400")]
    assert jsontext.repeats_members(root)
    assert jsontext.dump(jsontext.replaced(root, ["1.10", "X", "Y", "Z", "1e400"])) == '{"a":[1.10,"X",null,true,{"b":"Y"}],"a":"Z","n":1e400}'
    for values in (["1.1", "X", "Y", "Z", "1e400"], ["1.10"], ["1.10", "X", "Y", "Z", "1e400", "more"]):
        with pytest.raises(jsontext.Refused):
            jsontext.replaced(root, values)
    df = spark.createDataFrame([(1, "[" * 70 + "]" * 70), (2, "[" + "1," * 10001 + "1]"), (3, "{"), (4, None), (5, '{"card": 4785380592391139}'), (6, '{"to": "a@x.com", "n": 5}')], "id long, body string")
    errors = {r["id"]: r["error_class"] for r in jsontext.json_leaves(df, "body", ["id"]).collect()}
    assert errors == {1: "mapping_too_deep", 2: "mapping_too_large", 3: "shape_request", 4: None, 5: None, 6: None}
    found = {r["id"]: (r["findings"], r["error_class"]) for r in jsontext.detect_json(df, "body", ["id"]).collect()}
    assert found[5][1] == "tool_numeric_personal_data" and [tuple(f) for f in found[6][0]] == [(0, 0, 7, "EMAIL")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text("ab", max_size=3)), st.text("ab \n", min_size=1, max_size=8)), min_size=1, max_size=5))
def test_joined_leaves_split_again(items):
    leaves = [jsontext.Leaf(k, "string", v) for k, v in items]
    joined = jsontext.join(leaves)
    assert [joined.text[a:b] for a, b in joined.ranges] == [v for _, v in items]
    spans = [(a, b, "X") for a, b in joined.ranges]
    assert jsontext.split(joined, spans) == [(i, 0, len(v), "X") for i, (_, v) in enumerate(items)]


def test_split_edges():
    j = jsontext.join([jsontext.Leaf("name", "string", "Ann"), jsontext.Leaf(None, "string", "Bo")])
    assert j.text == "name: Ann\n\nBo"
    assert jsontext.split(j, [(0, 4, "X")]) == [] and jsontext.split(j, [(2, 9, "X")]) == [(0, 0, 3, "X")]
    with pytest.raises(jsontext.Refused):
        jsontext.split(j, [(7, 13, "X")])


def test_audit(spark, tmp_path):
    found = spark.createDataFrame([(1, "EMAIL", "a", False), (1, "EMAIL", "a", False), (1, "PERSON", "p", True), (1, "ODD", "o", False)], "request long, entity_type string, value string, numeric boolean")
    requests = spark.createDataFrame([(1, 3), (2, 1)], "request long, texts int")
    events = {r["request"]: r for r in audit.masked_events(found, requests, ["request"]).collect()}
    assert events[1]["spans"] == 4 and events[1]["redacted"] == 3 and events[1]["forwarded"] == 1 and events[1]["types"] == {"EMAIL": 1, "PERSON": 1, "unvalidated": 1}
    assert events[2]["spans"] == 0 and events[2]["types"] == {}
    ended = audit.outcome_events(spark.createDataFrame([("completed", None), ("odd", "odd"), ("refused", "shape_request")], "status string, error_class string")).collect()
    assert [(r["result"], r["error"]) for r in ended] == [("completed", None), ("aborted", None), ("refused", "shape_request")]
    path = str(tmp_path / "journal")
    for _ in range(2):
        audit.append(requests, path)
    assert spark.read.json(path).count() == 4
    assert len(audit.ERRORS) == 28 and len(audit.STREAM_ERRORS) == 22
    journal = audit.Journal(str(tmp_path / "journal.jsonl"))
    journal.append({"event": "masked", "spans": 1})
    with open(journal.path, "ab") as f:
        f.write(b'{"event": "mas')  # a failure
    journal.append({"event": "outcome"}, durable=False)
    assert journal.events() == [{"event": "masked", "spans": 1}, {"event": "outcome"}]
    assert len(audit.new_salt()) == 32 and audit.new_salt() != audit.new_salt()
    identity = spark.createDataFrame([("a", "s"), ("b", "s")], "credential string, session string")
    assert len({tuple(r) for r in identity.select(*audit.session_identity(b"salt", F.col("credential"), F.col("session"))).collect()}) == 2
    stamped = audit.stamped(requests, F.lit("2024-05-06 07:08:09.5").cast("timestamp")).first()["ts"]
    assert stamped == "2024-05-06T07:08:09.500Z"
    df = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")
    keys = [r[0] for r in df.select(audit.digest(b"salt", F.col("x"), F.col("y"))).collect()]
    assert len(set(keys)) == 2 and all(len(k) == 32 for k in keys)
    assert spark.createDataFrame([("ok:1",), ("no no",), ("x" * 129,)], "s string").where(audit.session_id_ok("s")).count() == 1
    assert json.loads("{}") == {}


def test_admission(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    live = [("a", "2024-01-01 00:50:00", 1), ("b", "2024-01-01 00:55:00", 0), ("c", "2024-01-01 00:45:00", 0), ("old", "2024-01-01 00:10:00", 1), ("held", "2024-01-01 00:10:00", 2)]
    live = spark.createDataFrame(live, "id string, last_seen string, tier int").withColumn("last_seen", F.col("last_seen").cast("timestamp"))

    def admit(arrivals, most):
        after, answers = sessions.admit(live, spark.createDataFrame([(x,) for x in arrivals], "id string"), ["id"], now, most=most)
        return {r["id"] for r in after.collect()}, {r["id"]: r["error_class"] for r in answers.collect()}

    assert admit(["x"], 5) == ({"a", "b", "c", "held", "x"}, {"x": None})
    assert admit(["x"], 4) == ({"a", "b", "held", "x"}, {"x": None})  # the oldest of the cheapest goes
    assert admit(["c", "x", "y"], 4) == ({"c", "held", "x", "y"}, {"c": None, "x": None, "y": None})
    assert admit(["w", "x", "y", "z"], 4) == ({"held", "w", "x", "y"}, {"w": None, "x": None, "y": None, "z": "session_saturated"})
    assert admit([], 1)[0] == {"a", "b", "c", "held"}


def test_numbering_over_many_literals_is_folded_by_blocks(spark, monkeypatch):
    """Literals of mixed types, in blocks of eight numbers: the same numbers as one after another."""
    monkeypatch.setattr(pseudonyms, "NUMBERS_AT_ONCE", 8)
    pick = random.Random(7)
    kinds = ["EMAIL", "PERSON", "IBAN"]
    values = [(s, f"v{i}", pick.choice(kinds[: s + 1]), i) for s in range(3) for i in range(60)]
    wrote = sorted({(s, pick.choice(kinds[: s + 1]), pick.randrange(1, 110)) for s in range(3) for _ in range(90)})
    want = {}
    for s in range(3):
        taken, n = {(k, m) for t, k, m in wrote if t == s}, 0
        for _, v, kind, _ in (x for x in values if x[0] == s):
            n += 1
            while (kind, n) in taken:
                n += 1
            want[s, v] = n
    table = spark.createDataFrame(values, "s int, value string, entity_type string, first int")
    literals = spark.createDataFrame([(s, f"[{k}_{m}]") for s, k, m in wrote], "s int, token string")
    assert {(r.s, r.value): r.n for r in pseudonyms.number(table, ["s"], literals).collect()} == want
