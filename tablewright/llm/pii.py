"""Personal data with offsets, through disguises.

Detection runs twice. The base rules read the source text. Then a chain of transducers
rewrites it, each reading what the one before it wrote: characters that look like ASCII
become that and invisible ones go; ``[at]``, ``(dot)`` and the like become marks; spelled
digits become digits; bare ``at`` and ``dot`` within an address become ``@`` and ``.``. Each keeps, for every
stretch it rewrote, where it came from, so what the rules find in the end is mapped back
through the chain to source characters. A span is added where something inside it was
rewritten, unless it lies within a base span of its kind. Base spans always stay, beside a
longer one that holds them as well.

A disguise counts only in a telling place, so prose that merely says "at", "dot" or "one" is
left alone: bracketed marks must stand between word characters, bare ``at`` and ``dot`` must
spell a whole address that ends in a common top domain, and spelled digits must come in runs of at least four.

Offsets are code points, end exclusive. Scale: a map without shuffle; rules are written so
that no text makes them backtrack over more than the match itself. Defined results: a null
or empty text has no spans; repeated rows give repeated results; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.words import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# The four base rules, written without needless backtracking.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches; each starts at the run of local characters before an ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            # An @ is no local character, so nothing before it belongs to a later match.
            done = at + 1
            at = text.find("@", done)


def ips(text: str) -> Iterator[Span]:
    if not _DOTTED.search(text):
        return
    for found in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.group().split(".")):
            yield found.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        n = ord(digit) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> Iterator[Span]:
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 13:
            digits = _digits(found.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[Span]:
    for found in _PHONE.finditer(text):
        if 9 <= len(_digits(found.group())) <= 15:
            yield found.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Characters that look like ASCII, and what they look like.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".", "．": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ",
}
#: By rule: whatever Unicode's compatibility forms call one ASCII character (full-width, mathematical, circled), and decimal digits of all scripts.
LOOKALIKES = {c: n for c in range(0x100, 0x20000) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and "!" <= n <= "~"}
LOOKALIKES |= {c: str(n) for c in range(0x100, 0x20000) if (n := unicodedata.decimal(chr(c), -1)) >= 0} | {ord(k): v for k, v in _LOOKALIKES.items()}
_INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0f\ufeff\u00ad"

_UNUSUAL = re.compile("[" + "".join(re.escape(chr(c)) for c in LOOKALIKES) + _INVISIBLE + "]")
_UNUSUAL_LATIN = [c for c in [*map(chr, LOOKALIKES), *_INVISIBLE] if ord(c) < 256]

# Spelled digits of the corpus's languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_SPELLED_GAP = r"(?:[ ]?\(0\)[ ]?|[ ,-]{1,2}|[ ]?(?:\.|dot|punkt|point|punto)[ ]?)"
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[ -])?(?:{_DIGIT}|[0-9]++)(?:{_SPELLED_GAP}(?:{_DIGIT}|[0-9]++)(?!\w))++")
_SPELLED_PART = re.compile(rf"(?i)plus[ -]|{_DIGIT}|[ ]?(?:dot|punkt|point|punto)[ ]?|\(0\)|[ ,-]+|[0-9.]")
_SPELLED_WORD = re.compile(rf"(?i)(?<![^\W\d_]){_DIGIT}(?![^\W\d_])")
_HINT = re.compile(rf"(?i)(?<!\w){_DIGIT}[ ,.-]{{1,2}}(?:{_DIGIT}|dot|punkt|point|punto)(?!\w)")
_MARK = re.compile(r"(?i)[ \t]*[\[({<][ \t]*(at|@|arroba|dot|punkt|punto|point|\.)[ \t]*[\])}>][ \t]*")
#: What bracketed marks become until all is rewritten: two characters that are free for private use.
_DOT, _AT = "\ue000", "\ue001"
_GAP = rf"(?:[ ]dot[ ]|{_DOT}|\.)"
_BARE = re.compile(rf"(?i)(?<![\w.%+-])([A-Za-z0-9_%+-]++(?:{_GAP}[A-Za-z0-9_%+-]++){{0,3}})([ ](?:at|arroba)[ ]|@|{_AT})([A-Za-z0-9-]++(?:{_GAP}[A-Za-z0-9-]++){{1,4}})(?![\w-])")
_BARE_DOT = re.compile(r"(?i) dot ")
_LAST_GAP = re.compile(rf"(?i).*{_GAP}")
_TOP = frozenset("com org net edu gov io info biz de fr es uk eu co me us app dev example".split())  # fixed values: top domains that a bare disguise may end in


class Edits:
    """Rewritten stretches of a text, and the way back from the result to the source."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]) -> None:
        parts, at, made = [], 0, 0
        #: For each stretch: where it begins in the result and in the source, and whether it was rewritten.
        self.begins: list[int] = []
        self.sources: list[tuple[int, int, bool]] = []
        for start, end, new in edits:
            if start > at:
                self._add(made, at, start, False)
                parts.append(text[at:start])
                made += start - at
            if new:
                self._add(made, start, end, True)
            parts.append(new)
            made, at = made + len(new), end
        if at < len(text):
            self._add(made, at, len(text), False)
            parts.append(text[at:])
        self.text = "".join(parts)

    def _add(self, made: int, start: int, end: int, new: bool) -> None:
        self.begins.append(made)
        self.sources.append((start, end, new))

    def back(self, start: int, end: int) -> tuple[Span, bool]:
        """The source span of a span of the result, and whether a rewritten stretch is in it."""
        first, last = bisect_right(self.begins, start) - 1, bisect_right(self.begins, end - 1) - 1
        a, b = self.sources[first], self.sources[last]
        source_start = a[0] if a[2] else a[0] + start - self.begins[first]
        source_end = b[1] if b[2] else b[0] + end - self.begins[last]
        # Removed characters lie between stretches: the span is longer in the source.
        changed = any(s[2] for s in self.sources[first : last + 1]) or source_end - source_start != end - start
        return (source_start, source_end), changed


def _spelled_edits(text: str) -> Iterator[tuple[int, int, str]]:
    words = text.lower().replace("-", " ").replace(",", " ").replace(".", " ").split()
    if sum(map(SPELLED.__contains__, words)) < 4 or not _HINT.search(text):
        return
    for run in _SPELLED_RUN.finditer(text):
        if len(_SPELLED_WORD.findall(run.group())) < 4:
            continue
        for part in _SPELLED_PART.finditer(text, run.start(), run.end()):
            word = part.group().lower()
            if word in SPELLED:
                yield part.start(), part.end(), SPELLED[word]
            elif word == "(0)":
                continue
            elif word.startswith("plus"):
                yield part.start(), part.end(), "+"
            elif word.strip() in ("dot", "punkt", "point", "punto"):
                yield part.start(), part.end(), "."
            elif word.isspace() or set(word) <= set(" ,-"):
                yield part.start(), part.end(), ""


def _mark_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for found in _MARK.finditer(text):
        before, after = text[found.start() - 1 : found.start()], text[found.end() : found.end() + 1]
        if before.isalnum() and after.isalnum():
            yield found.start(), found.end(), _AT if found.group(1).lower() in ("at", "@", "arroba") else _DOT


def _bare_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for found in _BARE.finditer(text):
        local, at, domain = found.groups()
        if _LAST_GAP.sub("", domain).lower() not in _TOP:
            continue
        # "look at example.com" is prose: a bare word needs a disguised dot beside it.
        bare = at not in ("@", _AT)
        if bare and not (_DOT in domain or _BARE_DOT.search(domain)):
            continue
        if at != "@":
            yield from ((m.start(), m.end(), ".") for m in _BARE_DOT.finditer(text, found.start(1), found.end(1)))
        if bare:
            yield found.start(2), found.end(2), "@"
        yield from ((m.start(), m.end(), ".") for m in _BARE_DOT.finditer(text, found.start(3), found.end(3)))


def _plain_edits(text: str) -> Iterator[tuple[int, int, str]]:
    if _unusual(text):
        for found in _UNUSUAL.finditer(text):
            yield found.start(), found.end(), "" if found.group() in _INVISIBLE else LOOKALIKES[ord(found.group())]


def _unusual(text: str) -> bool:
    """Whether the text has a lookalike or an invisible character; cheap for texts in Latin script."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _UNUSUAL.search(text) is not None
    return any(c in text for c in _UNUSUAL_LATIN)


#: The transducers in their order, each with a cheap test of whether it can have anything to do.
_STEPS: tuple[tuple[Callable[[str], bool], Callable[[str], Iterator[tuple[int, int, str]]]], ...] = (
    (lambda t: not t.isascii(), _plain_edits),
    (lambda t: "[" in t or "(" in t or "{" in t or "<" in t, _mark_edits),
    (lambda t: True, _spelled_edits),
    (lambda t: _DOT in t or " dot " in t or " DOT " in t or " Dot " in t, _bare_edits),
)


class Chain:
    """What the transducers made of a text, and the way back through all of them."""

    def __init__(self, text: str) -> None:
        self.steps: list[Edits] = []
        for can, edits in _STEPS:
            if can(text) and (found := sorted(edits(text))):
                self.steps.append(Edits(text, found))
                text = self.steps[-1].text
        self.text = text.replace(_DOT, ".").replace(_AT, "@") if self.steps else text

    def back(self, start: int, end: int) -> tuple[Span, bool]:
        """The source span of a span of the result, and whether a rewritten stretch is in it."""
        changed = False
        for step in reversed(self.steps):
            (start, end), rewritten = step.back(start, end)
            changed = changed or rewritten
        return (start, end), changed


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) by kind, each in order."""
    text = text or ""
    base = {kind: list(finder(text)) for kind, finder in FINDERS.items()}
    found = {kind: list(spans) for kind, spans in base.items()}
    chain = Chain(text)
    if chain.steps:
        for kind, finder in FINDERS.items():
            known = base[kind]
            starts = [s for s, _ in known]
            for start, end in finder(chain.text):
                (s, e), changed = chain.back(start, end)
                # Base spans do not overlap, so only the last that begins no later can hold this one.
                before = bisect_right(starts, s) - 1
                if changed and not (before >= 0 and e <= known[before][1]):
                    found[kind].append((s, e))
            found[kind].sort()
    return base, found


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in spans[kind])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and per row ``base`` and ``found``: arrays of (kind, start, end)."""

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def rows(spans: dict[str, list[Span]]) -> list[dict]:
            return [{"kind": k, "start": s, "end": e} for k in KINDS for s, e in spans[k]]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = [find(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([rows(b) for b, _ in both], kind), pa.array([rows(f) for _, f in both], kind)], names=["doc_id", "base", "found"])

        return each

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    spans = "array<struct<kind:string,start:long,end:long>>"
    return map_batches(rows, make, f"doc_id long, base {spans}, found {spans}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span of their text replaced by its kind in brackets; a null text stays null."""
    @F.pandas_udf("string")
    def redacted(texts):
        return texts.map(lambda t: None if t is None else _redacted(t))

    return docs.withColumn(text_col, redacted(docs[text_col].cast("string")))


def _redacted(text: str) -> str:
    _, found = find(text)
    # Of spans that begin together the longest comes first; what begins inside another only lengthens it.
    spans = sorted(((s, e, kind) for kind, each in found.items() for s, e in each), key=lambda x: (x[0], -x[1]))
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, a digest of the base spans and all spans of every document."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [_count("base", kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))


def _count(column: str, kind: str) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")
