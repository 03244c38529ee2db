"""Checks of identifiers, written from their public definitions.  Each takes a string, and answers False on garbage."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

_STRIP = str.maketrans("", "", " .-")

#: Account formats by country of the public IBAN registry (n digits, a capital letters, c either).
IBAN_FORMATS = {
    "AD": "8n12c", "AE": "19n", "AL": "8n16c", "AT": "16n", "AZ": "4a20c", "BA": "16n", "BE": "12n", "BG": "4a6n8c", "BH": "4a14c", "BI": "23n",
    "BR": "23n1a1c", "BY": "4c4n16c", "CH": "5n12c", "CR": "18n", "CY": "8n16c", "CZ": "20n", "DE": "18n", "DJ": "23n", "DK": "14n", "DO": "4c20n",
    "EE": "16n", "EG": "25n", "ES": "20n", "FI": "14n", "FK": "2a12n", "FO": "14n", "FR": "10n11c2n", "GB": "4a14n", "GE": "2a16n", "GI": "4a15c",
    "GL": "14n", "GR": "7n16c", "GT": "24c", "HR": "17n", "HU": "24n", "IE": "4a14n", "IL": "19n", "IQ": "4a15n", "IS": "22n", "IT": "1a10n12c",
    "JO": "4a4n18c", "KW": "4a22c", "KZ": "3n13c", "LB": "4n20c", "LC": "4a24c", "LI": "5n12c", "LT": "16n", "LU": "3n13c", "LV": "4a13c", "LY": "21n",
    "MC": "10n11c2n", "MD": "20c", "ME": "18n", "MK": "3n10c2n", "MN": "16n", "MR": "23n", "MT": "4a5n18c", "MU": "4a19n3a", "NI": "4a20n", "NL": "4a10n",
    "NO": "11n", "OM": "3n16c", "PK": "4a16c", "PL": "24n", "PS": "4a21c", "PT": "21n", "QA": "4a21c", "RO": "4a16c", "RS": "18n", "RU": "14n15c",
    "SA": "2n18c", "SC": "4a20n3a", "SD": "14n", "SE": "20n", "SI": "15n", "SK": "20n", "SM": "1a10n12c", "SO": "19n", "ST": "21n", "SV": "4a20n",
    "TL": "19n", "TN": "20n", "TR": "6n16c", "UA": "6n19c", "VA": "18n", "VG": "4a16n", "XK": "16n", "YE": "4a4n18c",
}
_CLASS = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Z0-9]"}
_IBAN = {c: re.compile("".join(f"{_CLASS[k]}{{{n}}}" for n, k in re.findall(r"(\d+)([nac])", f))) for c, f in IBAN_FORMATS.items()}
#: First digits of the uniform 13-digit German tax number by state; 5 and 9 stand alone.
STATE_PREFIXES = ("10", "11", "21", "22", "23", "24", "26", "27", "28", "30", "31", "32", "40", "41")


def strip(value: str) -> str:
    return value.translate(_STRIP)


def _digits(value: str, *sizes: int) -> bool:
    return len(value) in sizes and value.isascii() and value.isdigit()


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def credit_card(value: str) -> bool:
    v = strip(value)
    return _digits(v, *range(14, 20)) and luhn(v)


def iban(value: str) -> bool:
    v = strip(value).upper()
    if not v.isascii() or not v[2:4].isdigit() or v[:2] not in _IBAN or not _IBAN[v[:2]].fullmatch(v[4:]):
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def ch_avs(value: str) -> bool:
    v = strip(value)
    return _digits(v, 13) and v.startswith("756") and sum(int(d) * (1, 3)[i % 2] for i, d in enumerate(v)) % 10 == 0


def fr_nir(value: str) -> bool:
    v = strip(value).upper()
    if len(v) != 15:
        return False
    number = v[:5] + {"2A": "19", "2B": "18"}.get(v[5:7], v[5:7]) + v[7:]
    return _digits(number, 15) and 97 - int(number[:13]) % 97 == int(number[13:])


def fr_nif(value: str) -> bool:
    v = strip(value)
    return _digits(v, 13) and v[0] in "0123" and int(v[:10]) % 511 == int(v[10:])


def de_idnr(value: str) -> bool:
    v = strip(value)
    if not _digits(v, 11) or v[0] == "0":
        return False
    repeated = [n for n in Counter(v[:10]).values() if n > 1]
    if len(repeated) != 1 or repeated[0] > 3:
        return False
    check = 10  # ISO 7064, modulus 11,10
    for d in v[:10]:
        check = ((check + int(d)) % 10 or 10) * 2 % 11
    return (check + int(v[10])) % 10 == 1


def de_stnr(value: str) -> bool:
    """Structure only: 10 or 11 digits as the states write it, or the uniform 13."""
    v = strip(value).translate(str.maketrans("", "", "/,"))
    if _digits(v, 10, 11):
        return True
    return _digits(v, 13) and v[4] == "0" and (v[:2] in STATE_PREFIXES or v[0] in "59")


VALIDATORS: dict[str, Callable[[str], bool]] = {"iban": iban, "credit_card": credit_card, "ch_avs": ch_avs, "fr_nir": fr_nir, "fr_nif": fr_nif, "de_idnr": de_idnr, "de_stnr": de_stnr}
#: All but the structural one verify a checksum.
CHECKSUMS = frozenset(VALIDATORS) - {"de_stnr"}
