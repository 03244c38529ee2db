"""Texts with identifiers made from keys, by SQL that Spark and DuckDB both run, and what must be found in them.

Each kind of text has an identifier whose check digits are computed, or one that must not be found; the expected finding follows from
how the text was put together, not from searching it.
"""

from __future__ import annotations

from typing import NamedTuple

#: What is put for a wide integer type in each dialect.
SPARK, DUCKDB = "decimal(38,0)", "hugeint"


class Kind(NamedTuple):
    label: str
    value: str  # SQL over k
    tail: str
    found: tuple[str, float, int, bool] | None  # type, confidence, tier, boosted
    extra: str = "''"  # SQL of what else the finding covers, behind the value


def _digits(number: str, size: int) -> str:
    return f"lpad(cast({number} as varchar({size})), {size}, '0')"


def _digit(text: str, at: int) -> str:
    return f"cast(substr({text}, {at}, 1) as int)"


def _cut(text: str, *sizes: int, by: str = "' '") -> str:
    parts, at = [], 1
    for n in sizes:
        parts.append(f"substr({text}, {at}, {n})")
        at += n
    return f" || {by} || ".join(parts)


def _mod97(text: str) -> str:
    return _digits(f"98 - cast(cast({text} as WIDE) % 97 as int)", 2)


def _weighted(text: str, size: int) -> str:
    return " + ".join(f"{(1, 3)[i % 2]} * {_digit(text, i + 1)}" for i in range(size))


def _luhn(text: str, size: int) -> str:
    return " + ".join(f"2 * {_digit(text, i)} - case when {_digit(text, i)} > 4 then 9 else 0 end" if (size - i) % 2 == 0 else _digit(text, i) for i in range(1, size + 1))


_TEN = [f"((k + {i}) % 9 + 1)" for i in range(9)] + ["((k + k % 7) % 9 + 1)"]  # nine different digits, and one of them again


def _iso7064() -> str:
    check = "10"
    for d in _TEN:
        check = f"(2 * ((({check} + {d}) % 10 + 9) % 10 + 1)) % 11"
    return f"(11 - {check}) % 10"


_N9 = _digits("(k * 7919 + 11) % 1000000000", 9)
#: Numbers without their check digits, by column name, and numbers with them, of these columns.
PARTS = {
    "n18": _digits("(k * 104729 + 15485863) % 1000000000000000000", 18),
    "n12": _digits("(k * 7919 + 104729) % 1000000000000", 12),
    "avs12": f"'756' || {_N9}",
    "nir13": f"'1' || {_digits('k % 100', 2)} || '0575' || {_digits('k * 31 % 1000', 3)} || {_digits('k * 17 % 1000', 3)}",
    "nif10": f"'2' || {_N9}",
    "card15": f"'4' || {_digits('k * 7919 % 100000000000000', 14)}",
    "ten": " || ".join(f"cast({d} as varchar(1))" for d in _TEN),
    "iso": _iso7064(),
}
NUMBERS = {
    "iban_de": f"'DE' || {_mod97('(n18 || 131400)')} || n18",
    "bad_iban": f"'DE' || {_mod97('(n18 || 131400)').replace('98 -', '99 -')} || n18",
    "iban_be": f"'BE' || {_mod97('(n12 || 111400)')} || n12",
    "avs": f"avs12 || cast((10 - ({_weighted('avs12', 12)}) % 10) % 10 as varchar(1))",
    "nir": f"nir13 || {_digits('97 - cast(nir13 as bigint) % 97', 2)}",
    "nif": f"nif10 || {_digits('cast(nif10 as bigint) % 511', 3)}",
    "card": f"card15 || cast((10 - ({_luhn('card15', 15)}) % 10) % 10 as varchar(1))",
    "idnr": "ten || cast(iso as varchar(1))",
    "stnr13": f"'9' || {_digits('k % 1000', 3)} || '0' || {_digits('k * 7919 % 100000000', 8)}",
    "stnr10": f"'21/' || {_digits('k % 1000', 3)} || '/' || {_digits('k * 7 % 100000', 5)}",
}
_MAIL = "('u' || cast(k as varchar(20)) || '@mail.example')"

KINDS = (
    Kind("pay to ", _cut("iban_de", 4, 4, 4, 4, 4, 2), " now", ("IBAN", 1.0, 1, False)),
    Kind("pay to ", f"lower({_cut('iban_be', 4, 4, 4, 4)})", " BIC now", ("IBAN", 1.0, 1, False)),
    Kind("pay to ", "bad_iban", " now", None),  # check digits that no account has
    Kind("no. ", _cut("avs", 3, 4, 4, 2, by="'.'"), ".", ("CH_AVS", 1.0, 1, False)),
    Kind("Steuernummer ", "avs", " alt", ("CH_AVS", 1.0, 1, False)),  # outranks a tax number of the same digits
    Kind("nir ", _cut("nir", 1, 2, 2, 2, 3, 3, 2, by="chr(160)"), ", x", ("FR_NIR", 1.0, 1, False)),
    Kind("id ", _cut("idnr", 2, 3, 3, 3), " x", ("DE_STEUER_ID", 1.0, 1, False)),
    Kind("id 7 ", _cut("idnr", 2, 3, 3, 3), " x", None),  # a longer run of digits
    Kind("spi ", _cut("nif", 2, 2, 3, 3, 3), " x", ("FR_NIF", 1.0, 1, False)),
    Kind("unsere St.-Nr. lautet ", "stnr10", " x", ("DE_STEUERNUMMER", 0.9, 1, True)),
    Kind("ref ", "stnr10", " x", ("DE_STEUERNUMMER", 0.7, 1, False)),
    Kind("Steuernummer: ", "stnr13", " x", ("DE_STEUERNUMMER", 0.8, 1, True)),
    Kind("Steuernummer eins zwei drei vier fünf sechs ", "stnr13", " x", None),  # the trigger is out of reach
    Kind("card ", _cut("card", 4, 4, 4, 4, by="'-'"), " x", ("CREDIT_CARD", 1.0, 1, False)),
    Kind("card ", "card", "@mail.example", ("CREDIT_CARD", 1.0, 1, False), "'@mail.example'"),  # takes over the address that it begins
    Kind("write ", _MAIL, ", x", ("EMAIL", 0.95, 2, False)),
    Kind("½ oﬃce ", f"translate({_cut('avs', 3, 4, 4, 2)}, '0123456789', '０１２３４５６７８９')", " x", ("CH_AVS", 1.0, 1, False)),  # found in folded text, whose places differ
    Kind("½ oﬃce ", f"replace({_MAIL}, '@', '＠')", " x", ("EMAIL", 0.95, 2, False)),
)


def _case(parts: list[str]) -> str:
    return f"case k % {len(KINDS)} " + " ".join(f"when {i} then {p}" for i, p in enumerate(parts)) + " end"


def texts(table: str, key: str, wide: str) -> str:
    """SQL for (k, kind, before, v, after): a text is the last three joined."""
    labels, values, tails = ([f"'{x.label}'" for x in KINDS], [x.value for x in KINDS], [f"'{x.tail}'" for x in KINDS])
    parts, numbers = (", ".join(f"{v} as {n}" for n, v in d.items()) for d in (PARTS, NUMBERS))
    return f"""(select k, cast(k % {len(KINDS)} as int) as kind, repeat('é ', cast(k % 3 as int)) || {_case(labels)} as "before", {_case(values)} as v, {_case(tails)} as after
      from (select *, {numbers} from (select k, {parts} from (select cast({key} as bigint) as k from {table}) keyed) parted) numbered)""".replace("WIDE", wide)


def expected(table: str, key: str) -> str:
    """DuckDB SQL for (k, entity_type, start, end, confidence, tier, boosted) of what must be found."""

    def of(pick) -> str:
        return "case kind " + " ".join(f"when {i} then {pick(x)}" for i, x in enumerate(KINDS) if x.found) + " end"

    wanted = ", ".join(str(i) for i, x in enumerate(KINDS) if x.found)
    return f"""(select k, {of(lambda x: f"'{x.found[0]}'")} as entity_type, length("before") as "start", length("before") + length(v) + length({of(lambda x: x.extra)}) as "end",
      {of(lambda x: f"{x.found[1]}::double")} as confidence, ({of(lambda x: x.found[2])})::int as tier, {of(lambda x: str(x.found[3]).lower())} as boosted, "before", v, after,
      v || {of(lambda x: x.extra)} as value from {texts(table, key, DUCKDB)} where kind in ({wanted}))"""
