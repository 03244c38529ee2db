"""Settings in TOML.  Every setting is declared; one that isn't, or that isn't what it must be, is refused without telling its value."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from typing import Any, NamedTuple

from ..functions.places import FORMATS
from ..operators import sessions


class Setting(NamedTuple):
    fits: Callable[[Any], bool]
    says: str
    default: Any


def _whole(least: int) -> tuple[Callable[[Any], bool], str]:
    return lambda v: type(v) is int and v >= least, f"a whole number of {least} or more"


def _text(v: Any) -> bool:
    return isinstance(v, str) and v != ""


#: Settings by section, with what they must be and what they are if they aren't given.
SETTINGS: dict[str, dict[str, Setting]] = {
    "detection": {
        "catalog": Setting(_text, "a path", None),
        "layers": Setting(lambda v: isinstance(v, list) and all(map(_text, v)), "a list of layers", None),
        "cache_entries": Setting(*_whole(0), 0),
    },
    "sessions": {
        "idle_seconds": Setting(*_whole(1), sessions.IDLE_SECONDS),
        "most_sessions": Setting(*_whole(1), sessions.MOST_SESSIONS),
        "most_values": Setting(*_whole(1), sessions.MOST_VALUES),
    },
    "tools": {"most_chars": Setting(*_whole(1), 50_000), "most_calls": Setting(*_whole(1), 40)},
    "stream": {"client_format": Setting(lambda v: v in FORMATS[1:], f"one of {', '.join(FORMATS[1:])}", None)},
    "journal": {"path": Setting(_text, "a path", None), "durable": Setting(lambda v: isinstance(v, bool), "true or false", True)},
    "callers": {"credentials_sha256": Setting(lambda v: isinstance(v, list) and all(isinstance(x, str) and len(x) == 64 and set(x) <= set("0123456789abcdef") for x in v), "a list of SHA-256 digests", [])},
}


class Wrong(ValueError):
    """What is wrong with settings, by name and place; values are never told."""


def load(text: str) -> dict[str, dict[str, Any]]:
    """All settings, by section; refused settings are named together."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        place = str(e).rpartition("(")[2].rstrip(")")
        raise Wrong(f"not TOML ({place})") from None
    wrong = []
    for section, values in given.items():
        if section not in SETTINGS or not isinstance(values, dict):
            wrong.append(f"no section {section}")
            continue
        for name, value in values.items():
            if name not in SETTINGS[section]:
                wrong.append(f"no setting {section}.{name}")
            elif not SETTINGS[section][name].fits(value):
                wrong.append(f"{section}.{name} is {SETTINGS[section][name].says}")
    if wrong:
        raise Wrong("; ".join(wrong))
    return {section: {name: given.get(section, {}).get(name, s.default) for name, s in names.items()} for section, names in SETTINGS.items()}
