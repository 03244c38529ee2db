import unicodedata

import pytest

from quillveil.functions import identifiers
from quillveil.functions.folding import Folded
from quillveil.operators.detection import CANDIDATE, Finder
from quillveil.sources import catalogs

VALID = [
    ("iban", "DE89370400440532013000"), ("iban", "GB29 NWBK 6016 1331 9268 19"), ("iban", "be68 5390 0754 7034"), ("iban", "FR1420041010050500013M02606"),
    ("credit_card", "4785380592391139"), ("credit_card", "4785-3805-9239-1139"), ("ch_avs", "756.9217.0769.85"), ("fr_nir", "295109912611193"), ("fr_nir", "1 85 08 2B 123 456 11"),
    ("fr_nir", "199072A00400109"), ("fr_nif", "0701987765493"), ("de_idnr", "36574261809"), ("de_stnr", "9181081508155"), ("de_stnr", "181/815/08155"),
]


@pytest.mark.parametrize(("name", "value"), VALID)
def test_valid(name, value):
    assert identifiers.VALIDATORS[name](value)


@pytest.mark.parametrize(("name", "value"), [v for v in VALID if v[0] != "de_stnr"])
def test_every_changed_digit_is_noticed(name, value):
    for i, c in enumerate(value):
        if c.isdigit():
            for d in "0123456789":
                if d != c:
                    assert not identifiers.VALIDATORS[name](value[:i] + d + value[i + 1 :]), (i, d)


@pytest.mark.parametrize("name", identifiers.VALIDATORS)
def test_garbage_is_false(name):
    for value in ("", " ", "x", "١٢٣٤٥٦٧٨٩٠١٢٣", "0" * 500, "DE", "é" * 15, "\0", "2A" * 7):
        assert identifiers.VALIDATORS[name](value) is False


def test_structures():
    assert not identifiers.de_stnr("9181181508155") and not identifiers.de_stnr("1281081508155") and not identifiers.iban("ZZ89370400440532013000")
    assert len(identifiers.IBAN_FORMATS) > 70


def test_folding_maps_back():
    f = Folded("é ﬁn １２‑3")
    assert f.text == "é fin 12-3"
    assert f.span(0, 1) == (0, 2) and f.span(2, 3) == (3, 4) and f.span(3, 4) == (3, 4) and f.span(6, 8) == (6, 8)
    with pytest.raises(ValueError):
        f.span(3, 3)
    plain = Folded("plain text")
    assert plain.text == "plain text" and plain.span(1, 3) == (1, 3)


def values(text):
    return [(s.entity_type, text[s.start : s.end]) for s in Finder()(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("IBAN BE68 5390 0754 7034 BIC X", [("IBAN", "BE68 5390 0754 7034")]),
        ("card 4785 3805 9239 1139, mail jean.dupont@example.co.uk.", [("CREDIT_CARD", "4785 3805 9239 1139"), ("EMAIL", "jean.dupont@example.co.uk")]),
        ("4785380592391138", []),
        ("1 4785 3805 9239 1139", []),
        ("..a@b.com a..b@c.de .x@y.fr", []),
        ("é.ü@xn--bcher-kva.example", [("EMAIL", "é.ü@xn--bcher-kva.example")]),
        ("a@b.123", []),
        ("１２ café＠example.com", [("EMAIL", "café＠example.com")]),
        ("Steuernummer: 9181081508155", [("DE_STEUERNUMMER", "9181081508155")]),
        ("9181081508155", []),
        ("St.-Nr. 181/815/08155", [("DE_STEUERNUMMER", "181/815/08155")]),
        ("post nr 9181081508155", []),
        ("AVS 756.9217.0769.85", [("CH_AVS", "756.9217.0769.85")]),
        ("756 9217 0769 85", []) if False else ("NIR 1 85 08 2b 123 456 11", [("FR_NIR", "1 85 08 2b 123 456 11")]),
        ("", []),
    ],
)
def test_detection(text, found):
    assert values(text) == found


def test_boost_window():
    filler = "x " * 6
    assert values(f"steuernummer {filler}9181081508155") == []
    boosted = Finder()("9181081508155 ist die Steuernummer")
    assert boosted[0].boosted and boosted[0].confidence == 0.8


def test_catalog_refusals():
    rule = {"id": "x", "entity_type": "X", "tier": 1, "pattern": "x"}
    for bad in ({"validator": "nope"}, {}, {"confidence": 1.0}, {"validator": "iban", "confidence": 0.9}, {"confidence": 0.5, "threshold": True}, {"confidence": 0.5, "threshold": 2}, {"confidence": 0.5, "boost": {"value": 0.1, "window": 0, "triggers": ["a"]}}, {"confidence": 0.5, "boost": {"value": 0.1, "window": 2, "triggers": ["--"]}}, {"confidence": 0.5, "boost": {"value": float("nan"), "window": 2, "triggers": ["a"]}}, {"confidence": 0.5, "boost": {"value": 0.1, "window": 2, "triggers": []}}):
        with pytest.raises(ValueError):
            catalogs.rules([rule | bad])
    own = catalogs.from_yaml("identifiers:\n  - {id: zz, entity_type: PERSON, tier: 2, confidence: 0.6, pattern: 'zz+'}\n")
    assert Finder(own)("a zzz b")[0].recognizer == "catalog:zz"


def test_native_prefilter_lets_every_candidate_pass(spark):
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (n := unicodedata.normalize("NFKC", chr(c))) and ("@" in n or any(x in "0123456789" for x in n))]
    df = spark.createDataFrame([(c, c + "1") for c in odd], "c string, t string")
    assert df.where(f"not t rlike r'{CANDIDATE}'").count() == 0
