"""Conversation repair against plain Python."""

import hashlib
import re
import zlib
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillveil.llm import repair

WORD = r"[^\x20\x09-\x0D]"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired turns) of the rows of one conversation in order, trying all edits."""
    faults, seen = [], set()
    for _, role, text in rows:
        faults.append("blank" if not re.search(WORD, text) else "duplicate" if (role, text) in seen else "truncated" if re.findall(WORD, text)[-1] not in ".!?" else "")
        seen.add((role, text))
    accepts = re.compile(r"(s?(ua)+)?")
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, before):
        """(cost, letters, turns) of the cheapest end after a turn with that initial; inserts only where a turn can follow."""
        options = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        if i < len(rows):
            role, text, fault = *rows[i][1:], faults[i]
            more = 3 if fault == "truncated" else 0
            c, l, t = best(i + 1, before)
            options.append((c + 4, "D" + l, t))
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[0] in follows[before]:
                    c, l, t = best(i + 1, role[0])
                    options.append((c + more, "K" + l, ((role, text), *t)))
                for r in ("user", "assistant"):
                    if r[0] in follows[before]:
                        c, l, t = best(i + 1, r[0])
                        options.append((c + 3 + more, "R" + l, ((r, text), *t)))
        for made in (("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):  # more inserts at a place never pay
            state = before
            for r in made:
                state = r[0] if r[0] in follows[state or ""] else None
                if state is None:
                    break
            if state is not None:
                c, l, t = rest(i, state)
                options.append((c + 3 * len(made), "I" * len(made) + l, (*((r, "") for r in made), *t)))
        return min(options, key=lambda o: o[:2]) if options else (1 << 30, "", ())

    @cache
    def rest(i, before):
        """Like best, with a row next, or the end."""
        options = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        if i < len(rows):
            role, text, fault = *rows[i][1:], faults[i]
            more = 3 if fault == "truncated" else 0
            c, l, t = best(i + 1, before)
            options.append((c + 4, "D" + l, t))
            if fault not in ("blank", "duplicate"):
                for letter, r, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if r[:1] and r[0] in follows[before]:
                        c, l, t = best(i + 1, r[0])
                        options.append((c + cost + more, letter + l, ((r, text), *t)))
        return min(options, key=lambda o: o[:2]) if options else (1 << 30, "", ())

    cost, audit, turns = best(0, "")
    assert accepts.fullmatch("".join(r[0] for r, _ in turns))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, turns)


def key(role, text):
    return hashlib.sha256((hashlib.sha256(role.encode()).hexdigest() + text).encode()).digest()


def plain(rows):
    """The result's row of every conversation of damaged rows (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], key(r[2], r[3])))
        *counts, turns = plain_repair([r[1:] for r in own])
        out[conv] = (*counts, turns)
    return out


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


texts = st.sampled_from(["Yes.", "No", "", " \n", "What?", "Well. ", "b!"])
roles = st.sampled_from(["user", "assistant", "system", "tool", "unknown", " "])


@given(st.lists(st.tuples(st.none(), roles, texts), max_size=9))
@settings(max_examples=400, deadline=None)
def test_cheapest(rows):
    _, blank, duplicate, truncated, illegal, cost, audit, turns = plain_repair(rows)
    state, seen = repair._Audit(), set()
    for _, role, text in rows:
        fault = repair.BAD | repair.CUT if not text.strip() else repair.FINE if text.strip()[-1] in ".!?" else repair.CUT
        state.add(None, role, fault, 1, (role, text) in seen)
        seen.add((role, text))
    assert state.row() == (0, blank, duplicate, truncated, illegal, cost, audit)
    made = repair._Repair(audit)
    assert [x for _, role, text in rows for x in made.row(role, text)] + list(made.inserted()) == list(turns)


def test_blocks(monkeypatch):
    codes = bytes([(i * i * 7 + i // 3) % 12 for i in range(300)])
    whole = repair.cheapest(codes)
    for block in (1, 2, 7, 100, 300):
        monkeypatch.setattr(repair, "BLOCK", block)
        assert repair.cheapest(codes) == whole


def table_rows():
    said = ["Hello there.", "And then", None, "", "Why?", " ", "Good!\n", "Hello there."]
    rows = [(c, t, ("system" if t == 0 and c % 3 == 0 else ("user", "assistant", "tool", None)[(t + c * t) % 4 if c % 5 == 0 else t % 2]), said[(c * 5 + t * t) % len(said)]) for c in range(60) for t in range(c % 7)]
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (70, None, "user", "x."), (70, None, "assistant", "x."), (70, 3, "user", "x."), (70, 9, "assistant", "y.")]
    return rows + [(71, 1, "user", "same.")] * 4 + [(71, 1, "user", "same"), (71, 2, "", "no role."), (71, 2, "assistant", "long text. " * 200_000)]


def test_table(spark):
    rows = table_rows()
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(6)
    broken = repair.damaged(turns)
    assert sorted(map(str, (tuple(r) for r in broken.collect()))) == sorted(map(str, plain_damage(rows)))
    expected = plain(plain_damage(rows))
    none = (0, 0, 0, 0, 0, 0, "", ())
    all_ = {c: expected.get(c, none) for c in {r[0] for r in rows}}
    from pyspark.sql import functions as F

    got = repair.repaired_digests(broken, turns.select(F.col("conv_id").alias("conv")).distinct())
    assert {r.conv: tuple(r)[1:] for r in got.collect()} == {c: (*x[:-1], digest(x[-1])) for c, x in all_.items()}
    made = {}
    for r in sorted(repair.repair(broken).collect(), key=lambda r: r.place):
        made.setdefault(r.conv, []).append((r.role, r.text))
    assert made == {c: list(x[-1]) for c, x in expected.items() if x[-1]}


def test_long_conversation(spark):
    rows = spark.range(30_000).selectExpr("7L as conv", "id as turn", "case id % 2 when 0 then 'user' else 'assistant' end as role", "concat('t', id % 20000, case when id % 20000 % 11 = 0 then '' else '.' end) as text")
    r = repair.repaired_digests(rows, rows.select("conv").distinct()).first()
    assert (r.gaps, r.duplicate, r.illegal, len(r.audit)) == (0, 10_000, 0, 30_000) and r.audit[20_000:] == "D" * 10_000


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv long, turn long, role string, text string")
    assert repair.repaired_digests(rows, rows.select("conv")).count() == 0 and repair.repair(rows).count() == 0


@pytest.mark.parametrize("query", [repair.op13_conversation_repair])
def test_whole_table(spark, sf, query):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = plain(plain_damage(rows))
    got = query(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {c: (*x[:-1], digest(x[-1])) for c in {r[0] for r in rows} for x in [expected.get(c, (0, 0, 0, 0, 0, 0, "", ()))]}
