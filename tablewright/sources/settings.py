"""Dialect settings: defaults, what a sample tells, what the caller overrides."""

from __future__ import annotations

import codecs
import hashlib
from dataclasses import asdict, dataclass, fields, replace

DELIMITERS = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|", "space": " "}
QUOTES = {"double": '"', "single": "'"}
TERMINATORS = {"lf": "\n", "cr": "\r", "crlf": "\r\n"}
POLICIES = ("strict", "skip", "repair")
#: Labels under which web standards and spreadsheets know an encoding, and Java's name for it.
ENCODINGS = {"latin1": "windows-1252", "latin-1": "windows-1252", "iso-8859-1": "windows-1252", "ascii": "windows-1252", "utf8": "utf-8"}


@dataclass(frozen=True)
class ParseSettings:
    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    line_ending: str = "auto"
    encoding: str = "utf-8"
    has_headers: bool = True
    malformed: str = "skip"
    max_field_size: int = 262_144
    max_record_size: int = 2_097_152

    def identity(self) -> str:
        """The same for equal settings only: part of the key of cached artefacts."""
        return hashlib.sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()[:16]

    def terminator(self) -> str | None:
        """The record terminator; None leaves it to the reader."""
        return TERMINATORS.get(self.line_ending)

    def output_terminator(self) -> str:
        return TERMINATORS.get(self.line_ending, "\n")


def _one_byte(value: str) -> str | None:
    return value if len(value.encode()) == 1 else None


def _delimiter(value: str) -> str | None:
    return DELIMITERS.get(value.lower()) or _one_byte(value)


def _quote(value: str) -> str | None:
    return QUOTES.get(value.lower()) or _one_byte(value)


def _line_ending(value: str) -> str | None:
    return value.lower() if value.lower() in (*TERMINATORS, "auto") else None


def canonical_encoding(label: str) -> str | None:
    """Java's name of an encoding; None for a label that nobody knows."""
    name = ENCODINGS.get(label.strip().lower(), label.strip().lower())
    try:
        codecs.lookup(name)
    except (LookupError, ValueError):
        return None
    return name


def with_overrides(found: ParseSettings, overrides: dict | None) -> ParseSettings:
    """``found`` with the overrides that make sense; others leave what was found.

    ``escape`` may be none or off, backslash or one byte. An unknown ``malformed`` policy or
    field name is an error.
    """
    overrides = {k: v for k, v in (overrides or {}).items() if v is not None}
    if unknown := set(overrides) - {f.name for f in fields(ParseSettings)}:
        raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
    new: dict = {}
    for name, read in (("delimiter", _delimiter), ("quote", _quote), ("line_ending", _line_ending)):
        if name in overrides and (value := read(str(overrides[name]))) is not None:
            new[name] = value
    if "escape" in overrides:
        value = str(overrides["escape"])
        if value.lower() in ("none", "off"):
            new["escape"] = None
        elif escape := ("\\" if value.lower() == "backslash" else _one_byte(value)):
            new["escape"] = escape
    if "encoding" in overrides and (encoding := canonical_encoding(str(overrides["encoding"]))):
        new["encoding"] = encoding
    if "malformed" in overrides:
        if overrides["malformed"] not in POLICIES:
            raise ValueError(f"malformed must be one of {', '.join(POLICIES)}")
        new["malformed"] = overrides["malformed"]
    if "has_headers" in overrides:
        new["has_headers"] = bool(overrides["has_headers"])
    for name in ("max_field_size", "max_record_size"):
        if name in overrides:
            new[name] = int(overrides[name])
    return replace(found, **new)
