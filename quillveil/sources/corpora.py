"""Annotated corpora from seeds: sentences and documents with identifiers whose checksums hold, and where they are.

Every row follows from the seed and its number alone, so rows are made by the executors and a retried task makes the same ones.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import identifiers

Maker = Callable[[random.Random], str]


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices(string.digits, k=n))


def _grouped(text: str, rng: random.Random, *sizes: int, by: str = " ") -> str:
    """The text as it is, or in groups."""
    if rng.random() < 0.4:
        return text
    parts, at = [], 0
    for n in sizes:
        parts.append(text[at : at + n])
        at += n
    return by.join(parts)


def _found(rng: random.Random, draw: Maker, valid: Callable[[str], bool]) -> str:
    """The first drawn value that is valid."""
    while not valid(value := draw(rng)):
        pass
    return value


def iban(rng: random.Random) -> str:
    country = rng.choice([c for c, form in identifiers.IBAN_FORMATS.items() if form.endswith("n") and form[:-1].isdigit()])
    body = _digits(rng, int(identifiers.IBAN_FORMATS[country][:-1]))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    value = f"{country}{check:02d}{body}"
    return _grouped(value, rng, *[4] * (len(value) // 4), *([len(value) % 4] if len(value) % 4 else []))


def credit_card(rng: random.Random) -> str:
    body = rng.choice("3456") + _digits(rng, 14)
    value = next(body + d for d in string.digits if identifiers.luhn(body + d))
    return _grouped(value, rng, 4, 4, 4, 4, by=rng.choice(" -"))


def ch_avs(rng: random.Random) -> str:
    body = "756" + _digits(rng, 9)
    return _grouped(next(body + d for d in string.digits if identifiers.ch_avs(body + d)), rng, 3, 4, 4, 2, by=".")


def fr_nir(rng: random.Random) -> str:
    body = f"{rng.choice('12')}{_digits(rng, 2)}{rng.randint(1, 12):02d}{rng.randint(1, 95):02d}{_digits(rng, 6)}"
    return _grouped(f"{body}{97 - int(body) % 97:02d}", rng, 1, 2, 2, 2, 3, 3, 2)


def fr_nif(rng: random.Random) -> str:
    body = rng.choice("0123") + _digits(rng, 9)
    return _grouped(f"{body}{int(body) % 511:03d}", rng, 2, 2, 3, 3, 3)


def de_steuer_id(rng: random.Random) -> str:
    def draw(r: random.Random) -> str:
        own = r.sample(string.digits, 9)
        own.insert(r.randrange(10), r.choice(own))
        return "".join(own) + r.choice(string.digits)

    return _grouped(_found(rng, draw, identifiers.de_idnr), rng, 2, 3, 3, 3)


def de_steuernummer(rng: random.Random) -> str:
    return f"{_digits(rng, 2)}/{_digits(rng, 3)}/{_digits(rng, 5)}"


def email(rng: random.Random) -> str:
    name = "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9)))
    return f"{name}{rng.choice(['', '.', '-', '_'])}{_digits(rng, 2)}@{name[::-1]}.example"


#: What makes a value of each type.
MAKERS: dict[str, Maker] = {"CH_AVS": ch_avs, "CREDIT_CARD": credit_card, "DE_STEUERNUMMER": de_steuernummer, "DE_STEUER_ID": de_steuer_id, "EMAIL": email, "FR_NIF": fr_nif, "FR_NIR": fr_nir, "IBAN": iban}
#: Sentences by language; {} is where a value goes.
SENTENCES = {
    "de": ("Bitte senden Sie die Unterlagen an {} bis Freitag.", "In der Akte steht {}, gefolgt von {}.", "Kein Eintrag vorhanden."),
    "en": ("Please use {} for the transfer.", "We found {}, later {}; both in the file.", "Nothing to report today."),
    "fr": ("Merci de noter {} dans le dossier.", "Le courrier cite {}, puis {}.", "Rien à signaler."),
}


def sentence(seed: int, number: int) -> dict:
    """One annotated sentence: id, lang, text and entities (entity_type, start, end)."""
    rng = random.Random(f"{seed}/{number}")
    lang = rng.choice(sorted(SENTENCES))
    text, entities = "", []
    pieces = rng.choice(SENTENCES[lang]).split("{}")
    for i, piece in enumerate(pieces):
        text += piece
        if i + 1 < len(pieces):
            kind = rng.choice(sorted(MAKERS))
            value = MAKERS[kind](rng)
            entities.append({"entity_type": kind, "start": len(text), "end": len(text) + len(value)})
            text += value
    return {"id": f"{lang}-{number}", "lang": lang, "text": text, "entities": entities}


def document(seed: int, number: int) -> dict:
    """One annotated document: id and leaves (key, text, entities)."""
    rng = random.Random(f"{seed}/d/{number}")
    leaves = []
    for i in range(rng.randint(2, 12)):
        one = sentence(seed, rng.randrange(1 << 30))
        leaves.append({"key": rng.choice(["note", "subject", "body", f"field_{i}"]), "text": one["text"], "entities": one["entities"]})
    return {"id": f"doc-{number}", "leaves": leaves}


_ENTITIES = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _rows(spark: SparkSession, n: int, make: Callable[[int], dict], schema: str, types: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [make(i) for i in b.column(0).to_pylist()]
            names = list(rows[0]) if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)

    return spark.range(n).mapInArrow(run, schema)


def sentences(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n sentences, with the schema of an annotated corpus."""
    from .files import CORPUS

    return _rows(spark, n, lambda i: sentence(seed, i), CORPUS, [pa.string(), pa.string(), pa.string(), _ENTITIES])


def documents(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n documents of leaves, with the schema of an annotated corpus of documents."""
    from .files import DOCUMENTS

    leaf = pa.list_(pa.struct([("key", pa.string()), ("text", pa.string()), ("entities", _ENTITIES)]))
    return _rows(spark, n, lambda i: document(seed, i), DOCUMENTS, [pa.string(), leaf])
