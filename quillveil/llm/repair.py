"""Repair of conversation structure by the cheapest edits.

A repaired conversation is empty or has an optional system turn and then pairs of a user and an assistant turn.  Edits of rows in order: keep (0),
rerole to user or assistant (3), delete (4; the only one for blank and repeated rows), insert an empty user or assistant turn (3); a truncated row that
stays costs 3 more.

Arcs run between the layers of a graph: layer i lies before row i, and has a node for each state of the structure (start, after system,
after user, after assistant).  Forward minimum costs from the start and backward minimum costs to an accepting end identify the tight arcs, which
lie on a cheapest path; these form a DAG, because arcs within a layer (inserts) cost something.  The audit is the ASCII-least string of edit letters on it: a frontier of
nodes, all reached by the same letters, takes the least letter that any tight arc out of it has, and goes on with all targets of that letter.  The letters decide the roles:
the state before each is known.

Rows are a byte each there (role and fault), gathered in order from a narrow table, and backward costs are kept for every ``BLOCK``-th layer and
made again block by block, so a conversation takes about as much memory as its audit, which is one value of the result.  Texts are shuffled
once, sorted by conversation and turn, and stream past the audit into a digest; no conversation's texts are held.  A conversation's rows go through one task in order, as
its audit and its digest are sequential.

A null role or text is one space (so such a text is blank and such a role has no place in the structure).  Rows are ordered by turn, nulls first, then role, then
the SHA-256 of role and text; rows that are equal in all of these are repeats of the first.  A null conversation is a conversation of its own.  A role without any
character cannot stay as it is.  Very long texts are read whole, one at a time.  An empty table gives an empty result.  Other columns are ignored, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from . import textkit as K

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 1 << 60
#: The state after a turn with the initial s, u, a; after a made turn (user or assistant, whichever the structure has next).
_AFTER = ((SYSTEM, USER, None), (None, USER, None), (None, None, ASSISTANT), (None, USER, None))
_MADE = (USER, USER, ASSISTANT, USER)
_ENDS = (START, ASSISTANT)
#: A row's byte: the initial (3: another) and 4 times the fault.
FINE, CUT, BAD = 0, 4, 8
BLOCK = 4096


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, state, cost, next state) of the arcs over a row."""
    arcs = [("D", q, DELETE, q) for q in range(4)]
    if not code & BAD:
        more = TRUNCATED if code & CUT else 0
        initial = code & 3
        if initial < 3:
            arcs += [("K", q, more, to) for q in range(4) if (to := _AFTER[q][initial]) is not None]
        arcs += [("R", q, REROLE + more, _MADE[q]) for q in range(4)]
    return sorted(arcs)


ARCS = [_arcs(code) for code in range(16)]


def _inserted(costs: list[int], back: bool) -> list[int]:
    """Costs of a layer's nodes when turns may also be inserted there."""
    for _ in range(3):
        for q, to in enumerate(_MADE):
            a, b = (to, q) if back else (q, to)
            costs[b] = min(costs[b], costs[a] + INSERT)
    return costs


def _forward(costs: list[int], code: int) -> list[int]:
    out = [_NEVER] * 4
    for _, q, cost, to in ARCS[code]:
        out[to] = min(out[to], costs[q] + cost)
    return _inserted(out, False)


def _backward(costs: list[int], code: int) -> list[int]:
    out = [_NEVER] * 4
    for _, q, cost, to in ARCS[code]:
        out[q] = min(out[q], cost + costs[to])
    return _inserted(out, True)


def cheapest(codes: bytes) -> tuple[int, str]:
    """(least cost, the ASCII-least string of cheapest edits) of rows given by their bytes."""
    n = len(codes)
    last = _inserted([0 if q in _ENDS else _NEVER for q in range(4)], True)
    kept, layer = {n: last}, last
    for i in range(n - 1, -1, -1):
        layer = _backward(layer, codes[i])
        if i % BLOCK == 0:
            kept[i] = layer
    total = kept[0][START]
    ahead, letters = _inserted([0, _NEVER, _NEVER, _NEVER], False), []
    at, frontier, block = 0, {START}, []
    while True:
        if at == n:
            here, below = last, None
            if any(q in _ENDS and ahead[q] == total for q in frontier):
                return total, "".join(letters)
        else:
            if not block:  # backward costs from this layer to the next one kept
                high = min(n, at + BLOCK)
                block = [kept[high]]
                for i in range(high - 1, at - 1, -1):
                    block.append(_backward(block[-1], codes[i]))
                block.reverse()
            here, below = block[at % BLOCK], block[at % BLOCK + 1]
        tight = [("I", _MADE[q]) for q in frontier if ahead[q] + INSERT + here[_MADE[q]] == total]
        if below:
            tight += [(letter, to) for letter, q, cost, to in ARCS[codes[at]] if q in frontier and ahead[q] + cost + below[to] == total]
        letter = min(tight)[0]
        frontier = {to for x, to in tight if x == letter}
        letters.append(letter)
        if letter != "I":
            ahead = _forward(ahead, codes[at])
            at += 1
            block = [] if not at % BLOCK else block


def damaged(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with the faults that a checksum of conversation and turn plants in a fifth of the rows."""
    c, t = F.col(K._quoted(conversation)), F.col(K._quoted(turn))
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(c.cast("string"), blank), F.lit(":"), F.coalesce(t.cast("string"), blank)).cast("binary")) % 20
    rows = turns.select(c.alias("conv"), t.alias("turn"), F.coalesce(F.col(K._quoted(role)), blank).alias("role"), F.coalesce(F.col(K._quoted(text)), blank).alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv", "turn", "role", "text")


def _key() -> Column:
    return F.unhex(F.sha2(F.concat(F.sha2("role", 256), "text"), 256))


def _fault() -> Column:
    text = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    return F.when(F.length(text) == 0, BAD | CUT).when(F.right(text, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)


def _codes(rows: DataFrame, conversations: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """(conv, turn, role, key, fault, copies, again) in the order of each conversation, and a row without a key for every conversation.

    fault: of the text alone, both bits if it is blank; again: whether the first of the copies repeats an earlier row.
    """
    narrow = rows.select("conv", "turn", "role", _key().alias("key"), _fault().alias("fault"))
    counted = scratch.table(narrow.groupBy("conv", "turn", "role", "key", "fault").agg(F.count("*").alias("copies")))
    # a row with a null turn comes first
    first = counted.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unplaced"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    joined = counted.join(first, (F.col("key") == F.col("k")) & F.col("conv").eqNullSafe(F.col("c")), "left")
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("least"))), F.lit(False))
    all_ = joined.select("conv", "turn", "role", "key", "fault", "copies", again.alias("again")).unionByName(conversations, allowMissingColumns=True)
    return all_.repartition("conv").sortWithinPartitions("conv", F.col("key").isNotNull(), "turn", "role", "key")


class _Audit:
    """What is gathered of a conversation while its rows go by in order."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.before = self.last = None

    def add(self, turn: int | None, role: str, fault: int, copies: int, again: bool) -> None:
        initial = "sua".find(role[0]) if role else -1
        code = initial if initial >= 0 else 3
        pair = (self.before or "") + role[:1]
        if self.before is not None and pair not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1  # no role may follow itself
        self.before = role[:1]
        if fault & BAD:
            self.blank += copies
        else:
            self.duplicate += copies - 1 + again
            self.truncated += bool(fault and not again)
        bad = bool(fault & BAD) or again
        self.codes += bytes([code | (BAD if bad else fault)]) + bytes([code | BAD]) * (copies - 1)
        if turn is not None and turn != self.last:
            self.turns += 1
            self.last = self.most = turn
            self.least = turn if self.least is None else self.least

    def row(self) -> tuple:
        cost, audit = cheapest(bytes(self.codes))
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame, conversations: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
    schema = T.StructType([rows.schema["conv"], *(K.field(c, T.LongType()) for c in _COUNTS), K.field("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for b in batches:
            conv, turn, role, has, fault, copies, again = (b.column(i).to_pylist() for i in range(7))
            done = []
            for i, x in enumerate(conv):
                if has[i]:
                    open_[1].add(turn[i], role[i], fault[i], copies[i], again[i])
                else:
                    done += [open_] if open_ else []
                    open_ = (x, _Audit())
            if done:
                yield _batch([(c, *a.row()) for c, a in done], b.schema.field(0).type, schema)
        if open_:
            yield _batch([(open_[0], *open_[1].row())], b.schema.field(0).type, schema)

    return _codes(rows, conversations, scratch).select("conv", "turn", "role", F.col("key").isNotNull(), "fault", "copies", "again").mapInArrow(K.frees(run), schema)


class _Repair:
    """The turns of a repaired conversation, made while its rows go by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _made(self) -> str:
        self.state = _MADE[self.state]
        return "user" if self.state == USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._made(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _AFTER[self.state]["sua".index(role[0])]
            yield role, text
        elif letter == "R":
            yield self._made(), text


def _replayed(rows: DataFrame, conversations: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows (audit columns, role, text, has) in order, each conversation's audit before its rows; the audit columns."""
    with shared.Scratch(rows.sparkSession) as scratch:
        table = shared.table(audits(rows, conversations, scratch))  # read when the result is, so it stays
    both = table.unionByName(rows.withColumn("key", _key()), allowMissingColumns=True)
    dealt = both.repartition("conv").sortWithinPartitions("conv", F.col("key").isNotNull(), "turn", "role", "key")
    return dealt.select(*table.columns, "role", "text", F.col("key").isNotNull().alias("has")), table.columns


def repair(rows: DataFrame) -> DataFrame:
    """(conv, place, role, text): the turns of every repaired conversation in order; rows: (conv, turn, role, text), without null roles and texts."""
    replayed, _ = _replayed(rows, rows.select("conv").distinct())
    schema = T.StructType([rows.schema["conv"], K.field("place", T.LongType()), K.field("role", T.StringType()), K.field("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, place = None, None, 0
        for whole in batches:
            for b in K.slices(whole, "text"):
                made = []
                for c, audit, role, text, has in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    turns = own.row(role, text) if has else own.inserted() if own else ()
                    for turn in turns:
                        made.append((conv, place, *turn))
                        place += 1
                    if not has:
                        conv, own, place = c, _Repair(audit), 0
                yield _batch(made, b.schema.field(0).type, schema)
        if own:
            yield _batch([(conv, place + i, *turn) for i, turn in enumerate(own.inserted())], b.schema.field(0).type, schema)

    return replayed.select("conv", "audit", "role", "text", "has").mapInArrow(K.frees(run), schema)


def _batch(rows: list[tuple], key: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, key if i == 0 else K.ARROW[type(f.dataType)]) for i, (x, f) in enumerate(zip(columns, schema, strict=True))], names=schema.names)


def repaired_digests(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation; rows: (conv, turn, role, text)."""
    replayed, columns = _replayed(rows, conversations)
    schema = T.StructType([*(replayed.schema[c] for c in columns), K.field("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, sha, any_ = None, None, None, False

        def take(turns: Iterator[tuple[str, str]]) -> None:
            nonlocal any_
            for role, text in turns:
                sha.update(f"{chr(10) if any_ else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                any_ = True

        def done() -> tuple:
            take(own.inserted())
            return *head, sha.hexdigest()

        for whole in batches:
            for b in K.slices(whole, "text"):
                out = []
                for *audit, role, text, has in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if has:
                        take(own.row(role, text))
                        continue
                    if own:
                        out.append(done())
                    head, own, sha, any_ = audit, _Repair(audit[-1]), hashlib.sha256(), False
                yield _batch(out, b.schema.field(0).type, schema)
        if own:
            yield _batch([done()], b.schema.field(0).type, schema)

    return replayed.mapInArrow(K.frees(run), schema)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired_digests(damaged(turns), turns.select(F.col("conv_id").alias("conv")).distinct()).withColumnRenamed("conv", "conv_id")
