"""Finding a file's dialect, encoding and header from its first 64 KiB, on the driver."""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tablewright.sources.settings import TERMINATORS, ParseSettings, with_overrides
from tablewright.storage import hadoop_path

SAMPLE_BYTES = 64 * 1024
CANDIDATES = (",", "\t", ";", "|")
SAMPLE_LINES = 20
_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be"))
_NUMBER = re.compile(r"(?i)[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)")


@dataclass(frozen=True)
class Sniffed:
    """What a sample tells of a file."""

    settings: ParseSettings
    sample: bytes
    length: int


def read_sample(spark: SparkSession, path: str, size: int = SAMPLE_BYTES) -> tuple[bytes, int]:
    """(the first bytes, the length of the file), through Hadoop's file systems."""
    system, where = hadoop_path(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readNBytes(size)), system.getFileStatus(where).getLen()
    finally:
        stream.close()


def detect_encoding(sample: bytes, length: int | None = None) -> str:
    """A byte order mark wins; then UTF-8 if the sample is valid; else windows-1252.

    ``length`` is that of the file: only a sample shorter than it may end inside a character. Where
    it is not known, any sample may, but one that is nothing else says nothing of UTF-8.
    """
    for mark, name in _BOMS:
        if sample.startswith(mark):
            return name
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(sample, length is not None and len(sample) >= length)
    except UnicodeDecodeError:
        return "windows-1252"
    return "utf-8" if text or not sample else "windows-1252"


def decode(sample: bytes, encoding: str) -> str:
    text = codecs.getincrementaldecoder(encoding)("replace").decode(sample)
    return text.removeprefix("﻿")


def detect_line_ending(text: str) -> str:
    crlf = text.count("\r\n")
    lf, cr = text.count("\n") - crlf, text.count("\r") - crlf
    most = max(crlf, lf, cr)
    return "crlf" if crlf == most else "lf" if lf == most else "cr"


def detect_quote(text: str) -> str:
    double, single = text.count('"'), text.count("'")
    return "'" if single and (not double or double < single) else '"'


def detect_escape(text: str, quote: str) -> str | None:
    return "\\" if "\\" + quote in text else None


def count_fields(line: str, delimiter: str, quote: str) -> int | None:
    """The fields of a line; None if it is blank or a quote stays open. A doubled quote is a literal."""
    if not line.strip():
        return None
    # Doubled quotes toggle twice, so parity alone tells whether a place is quoted.
    parts = line.split(quote)
    if len(parts) % 2 == 0:
        return None
    return 1 + sum(part.count(delimiter) for part in parts[::2])


def detect_delimiter(text: str, quote: str) -> str | None:
    """The candidate that splits most of the first lines into the same number of fields, more than one."""
    lines = [line for line in re.split(r"\r\n|\n|\r", text) if line.strip()][:SAMPLE_LINES]
    best, best_lines = None, 0
    for candidate in CANDIDATES:
        counts = Counter(n for line in lines if (n := count_fields(line, candidate, quote)) is not None)
        if counts.total() < 2:
            continue
        n_fields, n_lines = max(counts.items(), key=lambda x: (x[1], x[0]))
        if n_fields > 1 and n_lines > best_lines:
            best, best_lines = candidate, n_lines
    return best


def is_numeric(value: str) -> bool:
    return _NUMBER.fullmatch(value.strip()) is not None


def _numeric_share(row: list[str]) -> float:
    return sum(map(is_numeric, row)) / len(row) if row else 0.0


def looks_like_header(rows: list[list[str]]) -> bool:
    """Whether the first of the first records names the columns; fewer than two records say yes."""
    if len(rows) < 2:
        return True
    first, second = _numeric_share(rows[0]), _numeric_share(rows[1])
    if first < 0.2 and second > 0.4:
        return True
    names = all(c.isalpha() or c in "_- " for value in rows[0] for c in value)
    return len(set(rows[0])) == len(rows[0]) and names and second > first


def records(text: str, settings: ParseSettings) -> list[list[str]]:
    """The records of a sample; blank lines are no records."""
    dialect = {"delimiter": settings.delimiter, "quotechar": settings.quote, "doublequote": settings.escape is None, "escapechar": settings.escape}
    ending = settings.terminator()
    # The csv module ends records at any line break; quoted ones must come through as they are.
    lines = io.StringIO(text, newline="" if ending != "\r" else None)
    csv.field_size_limit(1 << 30)
    return [row for row in csv.reader(lines, **dialect) if row]


def sniff(spark: SparkSession, path: str) -> Sniffed:
    sample, length = read_sample(spark, path)
    return Sniffed(settings_of(sample, length), sample, length)


def settings_of(sample: bytes, length: int | None = None) -> ParseSettings:
    encoding = detect_encoding(sample, length)
    text = decode(sample, encoding)
    quote = detect_quote(text)
    found = ParseSettings(delimiter=detect_delimiter(text, quote) or ",", quote=quote, escape=detect_escape(text, quote), line_ending=detect_line_ending(text), encoding=encoding)
    return with_overrides(found, {"has_headers": looks_like_header(records(text, found)[:2])})


def labels_of(sample: bytes, settings: ParseSettings) -> list[str]:
    """Column labels as stored: the first record, or ``Column 1`` to ``Column N`` without a header."""
    rows = records(decode(sample, settings.encoding), settings)
    first = rows[0] if rows else []
    return first if settings.has_headers else [f"Column {i}" for i in range(1, len(first) + 1)]


def shown_labels(labels: list[str]) -> list[str]:
    """Labels as shown: trimmed, blanks numbered."""
    return [label.strip() or f"Column {i}" for i, label in enumerate(labels, 1)]


def estimated_rows(sample: bytes, length: int, settings: ParseSettings) -> int | None:
    """The file's length over the mean line of the sample; None without a line break."""
    terminator = settings.output_terminator() if settings.line_ending in TERMINATORS else "\n"
    breaks = decode(sample, settings.encoding).count(terminator)
    return int(length / (len(sample) / breaks)) if breaks else None
