"""Chat formatting of reply trees.

Messages form trees by their parents.  Iterative self-joins double the distance that each message
sees towards its root, so a tree of depth d takes about log2(d) joins, in which only messages that haven't reached their root
take part, never all paths: they give each leaf's path length and total score.  The branches of a conversation are ranked
by total score (then length, then the leaf's id), the chosen leaves' ancestors are marked by the same jumps from the largest down, and each
chosen root-to-leaf path becomes one formatted conversation with a loss mask over its assistant texts.

The template marks turns with control strings.  Where a text holds one, with n backslashes before it, it gets 2n + 1
of them, and reading back halves them; a control string of the template itself never follows a backslash.

Null text or role: empty.  A missing parent makes a root.  Messages under a cycle of parents have no root and
belong to no path.  Repeated rows of a linear conversation are turns of their own.  Ties of score and length go to the smaller leaf.  Extra columns are ignored.  Very long texts are formatted
whole; a conversation is one row, so it has to fit in a task.  An empty table gives an empty result.  Texts are written once (to
number the messages) and shuffled only to their path; the tables of the joins are narrow and are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from . import textkit as K

#: Fixed values of the template: what opens and closes a turn of each role; other roles name themselves.
TURNS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": ("<s> ", " </s>")}
_CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]"
_ESCAPABLE = re.compile(rf"(?<!\\)(\\*+)({_CONTROL})")  # each run of backslashes is looked at once
_REAL = re.compile(rf"(?<!\\)(?:{_CONTROL})")


def escape(text: str) -> str:
    return _ESCAPABLE.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPABLE.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask: spans of the (escaped) assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        before, after = TURNS.get(role) or (f"[ROLE] {escape(role)} [/ROLE][ROLE] ", " [/ROLE]")
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after, "\n"]
        at += len(before) + len(body) + len(after) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    opens = {before.strip(): role for role, (before, _) in TURNS.items()}
    out, at, role = [], 0, None
    while at < len(formatted):
        start = _REAL.search(formatted, at)
        stop = _REAL.search(formatted, start.end())
        body = unescape(formatted[start.end() + 1 : stop.start() - 1])
        if start[0] == "[ROLE]" and role is None:
            role, at = body, stop.end()
            continue
        out.append((opens.get(start[0], role), body))
        role, at = None, stop.end() + 1
    return out


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(leaf, node, place) for every message on a chosen path; place counts from the leaf.

    nodes: (node, parent, conversation, score), node a unique long.
    """
    with shared.Scratch(nodes.sparkSession) as scratch:
        nodes = scratch.table(nodes)
        known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
        first = nodes.join(known, "parent", "left").select("node", "conversation", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("length"))
        first = scratch.table(first)
        # those at a root are finished; a jump table holds only what still climbs
        ended, jumps = first.where("up is null"), [first.where("up is not null")]
        most = max(2, nodes.count()).bit_length()  # beyond that only cycles are left
        while len(jumps) <= most and not jumps[-1].isEmpty():
            now = jumps[-1]
            far = now.unionByName(ended).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("length").alias("further"))
            step = now.join(far, "up").select("node", "conversation", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("further")).alias("length"))
            step = scratch.table(step)
            ended = ended.unionByName(step.where("up is null"))
            jumps.append(step.where("up is not null"))
        leaves = ended.join(first.where("up is not null").select(F.col("up").alias("node")).distinct(), "node", "left_anti")
        rank = Window.partitionBy("conversation").orderBy(F.desc("total"), F.desc("length"), "node")
        best = leaves.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= branches)
        marked = scratch.table(best.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("place"), "rank"))
        for k in range(len(jumps) - 1, -1, -1):
            jump = jumps[k].select("node", "up")
            marked = marked.union(marked.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("place") + (1 << k)).alias("place"), "rank"))
            if k % 4 == 0 and k:
                marked = scratch.table(marked)
        return shared.table(marked)


def _formatted(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(conversation, rank, formatted, mask) from (node, conversation, role, text) and chosen paths."""
    turn = F.struct((-F.col("place")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    groups = paths.join(messages, "node").groupBy("leaf", "conversation", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns")).drop("leaf")
    mask = T.ArrayType(T.StructType([K.field("start", T.LongType()), K.field("end", T.LongType())]))
    schema = T.StructType([messages.schema["conversation"], K.field("rank", T.LongType()), K.field("formatted", T.StringType()), K.field("mask", mask)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f for f, _ in made], pa.string()), pa.array([[{"start": x, "end": y} for x, y in s] for _, s in made], arrow)], names=schema.names)

    return groups.select("conversation", F.col("rank").cast("long").alias("rank"), "turns").mapInArrow(K.frees(run), schema)


def format_reply_trees(messages: DataFrame, conversation: str = "conv_id", node: str = "node_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = "score", branches: int = 1) -> DataFrame:
    """The best branches of each conversation: (conversation, rank, formatted, mask).

    Rows with a node id that are equal in every column are one message; a row without one is a message of its own.  Where
    messages share an id, replies to it belong to the best of them (by score, then role, text and parent).
    """
    own = messages.select(F.col(f"`{conversation}`").alias("conversation"), F.col(f"`{node}`").alias("id"), F.col(f"`{parent}`").alias("of"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"), (F.col(f"`{score}`").cast("double") if score else F.lit(0.0)).alias("score"))
    told_apart = own.where("id is not null").distinct().unionByName(own.where("id is null"))
    rows = shared.table(told_apart.withColumn("node", F.monotonically_increasing_id()))
    best = F.min_by("node", F.struct(-F.coalesce("score", F.lit(float("-inf"))), "role", "text", "of"))
    above = rows.where("id is not null").groupBy(F.col("conversation").alias("c"), F.col("id").alias("of_id")).agg(best.alias("parent"))
    own = rows.select("node", "conversation", "of", "score")
    linked = own.join(above, own["conversation"].eqNullSafe(above["c"]) & (own["of"] == above["of_id"]), "left").select("node", "parent", "conversation", "score")
    return _formatted(rows.select("node", "conversation", "role", "text"), chosen_paths(linked, branches))


def format_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations: each row answers the one before it by turn (ties by role, then text)."""
    own = turns.select(F.col(f"`{conversation}`").alias("conversation"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"), F.lit(0.0).alias("score"))
    rows = shared.table(own.withColumn("node", F.monotonically_increasing_id()))
    same = ["conversation", "turn", "role"]
    tied = rows.groupBy(*same).agg(F.count("*").alias("many")).where("many > 1").drop("many")
    on = [rows[c].eqNullSafe(tied[c]) for c in same]
    ties = rows.join(tied, on[0] & on[1] & on[2], "left_semi").select("node", F.dense_rank().over(Window.partitionBy(*same).orderBy("text")).alias("tie"))
    order = Window.partitionBy("conversation").orderBy("turn", "role", "tie", "node")  # texts go along only where they decide
    linked = rows.select("node", "conversation", "turn", "role", "score").join(ties, "node", "left").select("node", F.lag("node").over(order).alias("parent"), "conversation", "score")
    return _formatted(rows.select("node", "conversation", "role", "text"), chosen_paths(linked))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading formatted conversations back gives."""
    schema = T.StructType([formatted.schema["conversation"], K.field("n_turns", T.LongType()), K.field("turns_sha256", T.StringType()), K.field("loss_chars", T.LongType()), K.field("loss_sha256", T.StringType()), K.field("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, mask in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(f)
                loss = "".join(unescape(f[s["start"] : s["end"]]) for s in mask)
                rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(f)))
            c = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string() if i in (1, 3) else pa.int64()) for i, x in enumerate(c))], names=schema.names)

    return formatted.select("conversation", "formatted", "mask").mapInArrow(K.frees(run), schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(more))).withColumnRenamed("conversation", "conv_id")
