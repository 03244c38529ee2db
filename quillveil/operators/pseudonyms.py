"""Stable typed placeholders for found values, and their way back.

A mapping belongs to a session (any key columns).  Values are numbered in the order in which they first appear, with one
counter across types; the first type seen names a value for good, and types outside the vocabulary become
``REDACTED``.  A placeholder-shaped token that a caller wrote keeps its number out of use.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from ..sources.catalogs import ENTITY_TYPES, FALLBACK_TYPE
from . import scans
from .detection import detect

#: Fixed value: what a placeholder looks like.
TOKEN = r"\[[A-Z_]+_[0-9]+\]"


def tokens(text: Column) -> Column:
    """All placeholder-shaped tokens of a text, in order; texts without a bracket aren't searched."""
    return F.when(text.contains("["), F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)))


def has_token(text: Column) -> Column:
    return F.coalesce(text.contains("[") & text.rlike(TOKEN), F.lit(False))


#: What a type may be called in a placeholder.
TYPE_NAME, MOST_TYPE = re.compile("[A-Z]+(?:_[A-Z]+)*"), 40


def known_type(entity_type: Column, types: Iterable[str] = ENTITY_TYPES) -> Column:
    """A type of the vocabulary, or the fallback."""
    names = list(types)
    if wrong := [t for t in names if len(t) > MOST_TYPE or not TYPE_NAME.fullmatch(t)]:
        raise ValueError(f"no names of types: {', '.join(wrong)}")
    return F.when(entity_type.isin(*names), entity_type).otherwise(F.lit(FALLBACK_TYPE))


def written_tokens(df: DataFrame, session: list[str], text: str = "text") -> DataFrame:
    """(session, token) of the literals that callers wrote."""
    return df.select(*session, F.explode(tokens(F.col(f"`{text}`"))).alias("token")).distinct()


def first_values(found: DataFrame, session: list[str], position: list[str]) -> DataFrame:
    """(session, value, entity_type, first) of each distinct value: its first position (nulls first) and the type it had there."""
    at = F.struct(*position)
    return found.groupBy(*session, "value").agg(F.min_by(known_type(F.col("entity_type")), at).alias("entity_type"), F.min(at).alias("first"))


def _ranked(values: DataFrame, session: list[str]) -> DataFrame:
    """values with __rank, their place in their session by first; sessions are cut into ranges, so a large one is no task's alone."""
    cut = scans.Ranges(values, session, ["first"])
    return cut.running(cut.rows, "__rank", F.sum, F.lit(1)).drop(cut.part)


#: Fixed value: a placeholder's parts.
_PARTS = r"^\[([A-Z_]+)_([1-9][0-9]{0,8})\]$"


#: Numbers of a session that one task folds over.
NUMBERS_AT_ONCE = 1 << 16


def _heeded(ranked: DataFrame, session: list[str], wrote: DataFrame) -> DataFrame:
    """wrote with least: the first rank whose value heeds the literal, which is that of the first value not before since."""
    marks = wrote.select(*session, "kind", "m", F.col("since").alias("__at"), F.lit(0).alias("__value"))
    points = ranked.select(*session, F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("m"), F.col("first.at").alias("__at"), F.lit(1).alias("__value"))
    cut = scans.Ranges(marks.unionByName(points), session, ["__at", "__value"])
    return cut.running(cut.rows, "__before", F.sum, F.col("__value")).where("__value = 0").select(*session, "kind", "m", (F.col("__before") + 1).alias("least"))


def _folded(pdf: pd.DataFrame) -> tuple[int, list[int]]:
    """(steps after a block, ranks from which on numbers are one further) for its literals and the values that may meet them."""
    literals, values = pdf[pdf["m"].notna()].sort_values("m"), pdf[pdf["m"].isna()]
    types = dict(zip(values["__rank"].astype("int64"), values["kind"], strict=True))
    steps, ranks, last = int(pdf["__steps"].iloc[0]), [], None
    for m, kind, least in zip(literals["m"].astype("int64"), literals["kind"], literals["least"].astype("int64"), strict=True):
        rank = m - steps
        if m != last and rank >= least and types.get(rank) == kind:
            steps, last = steps + 1, m
            ranks.append(rank)
    return steps, ranks


def _steps(ranked: DataFrame, session: list[str], literals: DataFrame) -> DataFrame:
    """(session, __rank): from which ranks on the numbers are one further, because a literal has the number and type that would have come there.

    Literals are looked at by number.  With s steps so far, the value of rank m - s would get number m.  Numbers are cut into blocks, each with its literals
    and the values that they may meet; how many steps are taken before a block is assumed, at first none.  All blocks are folded at once, and what they then take is
    assumed next, until nothing changes: the first block is right after the first round, the next one after the second at the latest, and mostly all are
    after two or three, because the steps that a block takes hardly depend on those before it.  So no task has a whole session, and a round's work grows with the literals and
    values, not with their product.  Literals may have since, a place before which values (with first.at) don't heed them.
    """
    token, timed = F.col("token"), "since" in literals.columns
    wrote = literals.select(*session, F.regexp_extract(token, _PARTS, 1).alias("kind"), F.regexp_extract(token, _PARTS, 2).try_cast("long").alias("m"), F.col("since") if timed else F.lit(None).alias("since")).where("m is not null")
    wrote = wrote.groupBy(*session, "kind", "m").agg(F.min("since").alias("since"))
    wrote = _heeded(ranked, session, wrote) if timed else wrote.select(*session, "kind", "m", F.lit(0).cast("long").alias("least"))
    keys, size = [f"__s{i}" for i in range(len(session))], NUMBERS_AT_ONCE
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(session, keys, strict=True)]
    wrote = tables.table(wrote.select(*named, F.floor((F.col("m") - 1) / size).alias("__block"), "kind", "m", "least"))
    places = ranked.select(*named, F.col("entity_type").alias("kind"), F.col("__rank").cast("long").alias("__rank"))
    sizes = tables.table(wrote.groupBy(*keys, "__block").agg(F.countDistinct("m").alias("__most")))
    assumed = sizes.withColumn("__steps", F.lit(0).cast("long"))
    out = T.StructType([*[T.StructField(k, ranked.schema[c].dataType) for c, k in zip(session, keys, strict=True)], T.StructField("__block", T.LongType()), T.StructField("__taken", T.LongType()), T.StructField("__ranks", T.ArrayType(T.LongType()))])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        after, ranks = _folded(pdf)
        head = {k: [pdf[k].iloc[0]] for k in [*keys, "__block"]}
        return pd.DataFrame({**head, "__taken": [after - int(pdf["__steps"].iloc[0])], "__ranks": [ranks]})

    while True:
        # a block's values have the ranks of its numbers, less the steps taken before it and in it; each lies under two blocks of ranks at most
        window = assumed.select(*keys, "__block", "__steps", (F.col("__block") * size + 1 - F.col("__steps") - F.col("__most")).alias("__low"), ((F.col("__block") + 1) * size - F.col("__steps")).alias("__high"))
        bins = window.withColumn("__bin", F.explode(F.sequence(F.floor(F.greatest("__low", F.lit(0)) / size), F.floor(F.greatest("__high", F.lit(0)) / size))))
        met = tables.matching(places.withColumn("__bin", F.floor(F.col("__rank") / size)), bins, [*keys, "__bin"]).where("__rank between __low and __high")
        rows = tables.matching(wrote, assumed.drop("__most"), [*keys, "__block"]).withColumn("__rank", F.lit(None).cast("long"))
        both = rows.unionByName(met.select(*keys, "__block", "kind", F.lit(None).cast("long").alias("m"), F.lit(None).cast("long").alias("least"), "__steps", "__rank"))
        folded = tables.table(both.groupBy(*keys, "__block").applyInPandas(run, out))
        after = folded.select(*keys, "__block", F.coalesce(F.sum("__taken").over(before), F.lit(0)).alias("__now"))
        then = tables.table(tables.matching(assumed, after, [*keys, "__block"]))
        if then.where("__now <> __steps").isEmpty():
            break
        assumed = then.select(*keys, "__block", "__most", F.col("__now").alias("__steps"))
    return folded.select(*[F.col(k).alias(c) for c, k in zip(session, keys, strict=True)], F.explode(F.col("__ranks").cast("array<int>")).alias("__rank"))


def number(values: DataFrame, session: list[str], literals: DataFrame | None = None) -> DataFrame:
    """Adds n and placeholder.  Where callers wrote literals, numbering steps over the numbers of those of the same type.

    session may be empty: then all values are one session's.  Values that have their __rank already aren't ordered again.
    """
    ranked = values if "__rank" in values.columns else _ranked(values, session)
    if literals is None:
        numbered = ranked.withColumn("n", F.col("__rank").cast("int"))
    else:
        ranked = tables.table(ranked)
        moves = _steps(ranked, session, literals).withColumn("__step", F.lit(1)).withColumn("__value", F.lit(0))
        line = ranked.withColumn("__rank", F.col("__rank").cast("int")).withColumn("__step", F.lit(0)).withColumn("__value", F.lit(1)).unionByName(moves, allowMissingColumns=True)
        cut = scans.Ranges(line, session, ["__rank", "__value"])
        moved = cut.running(cut.rows, "__steps", F.sum, F.col("__step")).where("__value = 1")
        numbered = moved.withColumn("n", (F.col("__rank") + F.col("__steps")).cast("int")).drop("__step", "__steps", "__value", cut.part)
    return numbered.drop("__rank").withColumn("placeholder", F.format_string("[%s_%d]", "entity_type", "n"))


def splice(text: Column, pieces: Column) -> Column:
    """text with each [start, end) of pieces (start, end, placeholder; disjoint, in order) replaced."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, p: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, p["start"] - acc["at"]), p["placeholder"]).alias("out"), p["end"].alias("at"))

    done = F.aggregate(pieces, begin, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def mapping_columns(session: list[str]) -> dict[str, str]:
    """What a mapping calls its own columns beside those of its sessions: names that a session column has get an underscore."""
    out = {}
    for name in ("value", "entity_type", "first", "n", "placeholder"):
        out[name] = name
        while out[name] in session:
            out[name] += "_"
    return out


def pseudonymize(df: DataFrame, session: list[str], position: list[str], text: str = "text", literals: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(df with masked text, mapping).  position orders the rows of a session; it need not tell them apart.

    Texts are searched once.  Rows have a number of their own, so null or equal sessions and positions mask like any others (a null is a
    session, rows at one position are in any order); an empty session means one mapping for all rows.
    The mapping is the only table that holds values: session, value, entity_type, first, n, placeholder (see mapping_columns).
    Null texts stay null.
    """
    row, spans, wrote = tables.fresh(df, "__row"), tables.fresh(df, "__spans"), tables.fresh(df, "__tokens")
    own = F.col(f"`{text}`")
    searched = tables.table(detect(df, text, spans, **options).withColumns({row: F.monotonically_increasing_id(), wrote: tokens(own) if literals else F.lit(None).cast("array<string>")}))
    # from here on columns have names of their own, whatever the table's are
    keys, places = [f"__k{i}" for i in range(len(session))], [f"__p{i}" for i in range(len(position))]
    named_keys = [F.col(f"`{c}`").alias(k) for c, k in zip(session, keys, strict=True)]
    reserved = searched.where(F.size(wrote) > 0).select(*named_keys, F.explode(wrote).alias("token")).distinct()
    value = F.substring("__text", F.col("__s.start") + 1, F.col("__s.end") - F.col("__s.start"))
    found = searched.where(F.size(spans) > 0).select(F.col(row).alias("__row"), *named_keys, *[F.col(f"`{c}`").alias(p) for c, p in zip(position, places, strict=True)], own.alias("__text"), F.explode(spans).alias("__s"))
    found = found.select("__row", *keys, *places, F.col("__s.start").alias("__start"), F.col("__s.end").alias("__end"), F.col("__s.entity_type").alias("entity_type"), value.alias("value"))
    numbered = tables.alone(df.sparkSession, lambda: number(first_values(found, keys, [*places, "__row", "__start"]), keys, reserved if literals and not reserved.isEmpty() else None))
    mapping = df.sparkSession.read.parquet(numbered)
    issued = mapping.select(*keys, "value", "placeholder")
    named = found.join(issued, tables.same(found, issued, keys) & (found["value"] == issued["value"]))
    piece = F.struct(F.col("__start").alias("start"), F.col("__end").alias("end"), "placeholder")
    pieces = named.groupBy(F.col("__row").alias(row)).agg(F.sort_array(F.collect_list(piece)).alias("__pieces"))
    names = mapping_columns(session)
    mapping = mapping.select(*[F.col(k).alias(c) for k, c in zip(keys, session, strict=True)], *[F.col(c).alias(name) for c, name in names.items()])
    masked = searched.where(F.size(spans) > 0).join(pieces, row).withColumn(text, splice(own, F.col("__pieces")))
    untouched = searched.where(F.coalesce(F.size(spans), F.lit(0)) <= 0)
    return masked.select(*df.columns).unionByName(untouched.select(*df.columns)), mapping


def capped(mapping: DataFrame, session: list[str], most: int = 1000) -> DataFrame:
    """The earliest values of each session, as many as it may keep; numbers of declined values stay used."""
    rank = F.row_number().over(Window.partitionBy(*session).orderBy(mapping_columns(session)["n"]))
    return mapping.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def restore(df: DataFrame, mapping: DataFrame, session: list[str], row: list[str] | None = None, text: str = "text", strict: bool = True, written: DataFrame | None = None) -> DataFrame:
    """df with placeholders replaced by their values, and status and error_class.

    strict: a row with an unknown token is refused (its text null); else the token stays.
    written: (session, token) literals of callers, which are never restored.  Rows have a number of their own, so row isn't needed;
    null sessions are sessions.
    """
    names = mapping_columns(session)
    columns = {c: f"__k{i}" for i, c in enumerate(session)}
    table = mapping.select(*[F.col(f"`{c}`").alias(k) for c, k in columns.items()], F.col(names["placeholder"]).alias("token"), F.col(names["value"]).alias("value"))
    written = written.select(*[F.col(f"`{c}`").alias(k) for c, k in columns.items()], "token") if written is not None else None
    if written is not None:
        table = table.join(written, tables.same(table, written, [*columns.values(), "token"]), "left_anti")
        table = table.unionByName(written.withColumn("value", F.col("token")))
    id_ = tables.fresh(df, "__row")
    own = F.col(f"`{text}`")
    rows = tables.table(df.where(has_token(own)).withColumn(id_, F.monotonically_increasing_id()))  # the others stay as they are
    there = rows.select(F.col(id_).alias("__id"), *[F.col(f"`{c}`").alias(k) for c, k in columns.items()], F.posexplode(tokens(own)).alias("at", "token"))
    found = there.join(table, tables.same(there, table, list(columns.values())) & (there["token"] == table["token"]), "left")
    each = F.struct("at", F.coalesce(table["value"], there["token"]).alias("value"), table["value"].isNull().alias("unknown"))
    values = found.groupBy(F.col("__id").alias(id_)).agg(F.sort_array(F.collect_list(each)).alias("__values"))
    hit = rows.join(values, id_)
    parts = F.split(own, TOKEN, -1)
    restored = F.array_join(F.zip_with(parts, F.col("__values"), lambda p, v: F.concat(p, F.coalesce(v["value"], F.lit("")))), "")
    refused = F.exists("__values", lambda v: v["unknown"]) if strict else F.lit(False)
    done = hit.select(
        *[F.when(~refused, restored).alias(text) if c == text else F.col(f"`{c}`") for c in df.columns],
        F.when(refused, "refused").otherwise("completed").alias("status"),
        F.when(refused, "mapping_unknown_placeholder").alias("error_class"),
    )
    plain = df.where(~has_token(own)).select(*df.columns, F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error_class"))
    return done.unionByName(plain)
