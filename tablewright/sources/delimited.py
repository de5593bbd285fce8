"""Delimited text as a table: ``row_id`` and string columns ``c0`` to ``cN``.

Spark's own reader splits and decodes; the policy for malformed rows is a filter or an
expression over its result. Row ids are dense over kept rows, in file order: splits are
counted first, and a row's id is the number of rows in earlier splits plus its place in its own.
The count is one small row per split, so no task sees the whole file.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import has_replacement, truncate_utf8
from tablewright.sources import sniff
from tablewright.sources.records import positions, split_records, way, without_mark
from tablewright.sources.settings import ParseSettings, with_overrides
from tablewright.storage import Scratch

WARNING_LIMIT = 200
WARNING_SCHEMA = "record long, line long, byte long, field long, kind string, message string, expected_len long, len long"
_CORRUPT = "_corrupt"
#: Files beyond this are divided among tasks where that is possible.
SPLIT_BYTES = 64 << 20


def too_long(values: list[Column], settings: ParseSettings) -> tuple[Column, Column]:
    """Whether a field, and whether the record, has too many bytes of UTF-8."""
    sizes = [F.octet_length(v) for v in values]
    long_field = reduce(lambda a, b: a | b, [n > settings.max_field_size for n in sizes], F.lit(False))
    return long_field, reduce(lambda a, b: a + b, sizes, F.lit(0)) > settings.max_record_size


def repaired(values: list[Column], settings: ParseSettings) -> list[Column]:
    """Long fields cut at a character, then whole trailing fields dropped until the record fits."""
    total, out = F.lit(0), []
    for v in (truncate_utf8(v, settings.max_field_size) for v in values):
        total = total + F.octet_length(v)
        out.append(F.when(total <= settings.max_record_size, v).otherwise(F.lit("")))
    return out


def with_size_policy(table: DataFrame, settings: ParseSettings) -> DataFrame:
    """The size limits applied to a table that did not come from a file: skip drops, repair cuts, strict raises."""
    cells = [c for c in table.columns if c != "row_id"]
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]
    long_field, long_record = too_long(values, settings)
    if settings.malformed == "skip":
        return table.filter(~long_field & ~long_record)
    if settings.malformed == "strict":
        return table.filter(F.when(long_field | long_record, F.raise_error(F.lit("field or record too long")).cast("boolean")).otherwise(F.lit(True)))
    return table.select("row_id", *[v.alias(c) for v, c in zip(repaired(values, settings), cells, strict=True)])


@dataclass(frozen=True)
class Metadata:
    """What is known of a file before any row is read."""

    headers: list[str]
    detected: ParseSettings
    effective: ParseSettings
    estimated_count: int | None


@dataclass
class Source:
    """A delimited file opened with settings.

    ``reading`` says how one file is divided among tasks: ``whole`` not at all, which takes any
    file; ``lines`` at line breaks, for files without quoted ones; ``records`` at the ends of
    records, for files whose quotes are balanced. ``auto`` takes small files whole and looks
    through large ones, in parallel, for the way that fits.
    """

    spark: SparkSession
    path: str
    overrides: dict | None = None
    reading: str = "auto"
    metadata: Metadata = field(init=False)

    def __post_init__(self) -> None:
        if self.reading not in ("auto", "whole", "lines", "records"):
            raise ValueError("reading must be auto, whole, lines or records")
        found = sniff.sniff(self.spark, self.path)
        effective = with_overrides(found.settings, self.overrides)
        labels = sniff.labels_of(found.sample, effective)
        self.metadata = Metadata(labels, found.settings, effective, sniff.estimated_rows(found.sample, found.length, effective))
        if self.reading == "auto":
            self.reading = "whole" if found.length <= SPLIT_BYTES else way(self.spark, self.path, effective)

    @property
    def settings(self) -> ParseSettings:
        return self.metadata.effective

    @property
    def cells(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.metadata.headers))]

    def _scan(self) -> DataFrame:
        """Every record, with the raw text of those whose number of fields is wrong."""
        s = self.settings
        if self.reading == "records":
            return self._scan_records()
        options = {"sep": s.delimiter, "quote": s.quote, "escape": s.escape or s.quote, "header": s.has_headers, "enforceSchema": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "encoding": s.encoding, "multiLine": self.reading == "whole", "columnPruning": False, "maxCharsPerColumn": -1, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxColumns": max(20480, len(self.cells) + 1)}
        if s.terminator() and not (self.reading == "lines" and s.line_ending == "crlf"):
            options["lineSep"] = s.terminator()
        if s.encoding == "windows-1252":
            self.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*self.cells, _CORRUPT]])
        return self.spark.read.options(**options).schema(schema).csv(self.path)

    def _scan_records(self) -> DataFrame:
        """The same from records split in parallel; their order is in __file, __start and __seq."""
        s = self.settings
        records = without_mark(split_records(self.spark, self.path, s))
        if s.has_headers:
            first = records.groupBy("file").agg(F.min(F.struct("start", "seq")).alias("first"))
            records = records.join(F.broadcast(first), "file").filter(F.struct("start", "seq") != F.col("first"))
        schema = ", ".join(f"{c} string" for c in [*self.cells, _CORRUPT])
        options = {"sep": s.delimiter, "quote": s.quote, "escape": s.escape or s.quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n", "maxColumns": str(max(20480, len(self.cells) + 1))}
        parsed = records.select(F.col("file").alias("__file"), F.col("start").alias("__start"), F.col("seq").alias("__seq"), F.from_csv("raw", schema, options).alias("row"))
        return parsed.select("__file", "__start", "__seq", "row.*")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """``rows``, straight from a scan, with dense ids in file order as ``row_id``."""
        if self.reading == "records":
            from tablewright.operators.ordering import dense_rank_ids

            return dense_rank_ids(rows, [F.col("__file"), F.col("__start"), F.col("__seq")], "row_id").drop("__file", "__start", "__seq")
        split = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
        placed = rows.select("*", *split).withColumn("__place", F.monotonically_increasing_id())
        counts = placed.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("first")).orderBy("__file", "__start").collect()
        base, starts = 0, []
        for r in counts:
            starts.append((r["__file"], r["__start"], base - r["first"]))
            base += r["n"]
        shift = self.spark.createDataFrame(starts, "__file string, __start long, __shift long")
        joined = placed.join(F.broadcast(shift) if len(starts) <= 100_000 else shift, ["__file", "__start"])
        return joined.withColumn("row_id", F.col("__place") + F.col("__shift")).drop("__file", "__start", "__place", "__shift")

    def table(self) -> DataFrame:
        """row_id, c0..cN under the policy for malformed rows. Strict reading raises at the first of them."""
        s, cells = self.settings, self.cells
        rows = self._scan()
        values = [F.coalesce(F.col(c), F.lit("")) for c in cells]
        long_field, long_record = too_long(values, s)
        wrong = F.col(_CORRUPT).isNotNull()
        bad_text = reduce(lambda a, b: a | b, map(has_replacement, values), F.lit(False))
        if s.malformed == "strict":
            fault = F.when(wrong, "unequal-lengths").when(long_field, "max-field-size").when(long_record, "max-record-size").when(bad_text, "utf8")
            raised = F.raise_error(F.concat(F.lit("malformed record: "), fault)).cast("boolean")
            rows = rows.filter(F.when(fault.isNotNull(), raised).otherwise(F.lit(True)))
        elif s.malformed == "skip":
            rows = rows.filter(~wrong & ~long_field & ~long_record)
        else:
            values = repaired(values, s)
        kept = self._numbered(rows)
        return kept.select("row_id", *[v.alias(c) for v, c in zip(values, cells, strict=True)])

    def warnings(self, limit: int = WARNING_LIMIT) -> DataFrame:
        """The first warnings by physical record.

        Spark's reader does not tell where a record begins. Lines (from 1) and bytes (from 0) are
        counted in a pass of their own, for UTF-8 only; else they are null.
        """
        s, cells = self.settings, self.cells
        rows = self._numbered(self._scan()).withColumnRenamed("row_id", "record")
        values = [F.coalesce(F.col(c), F.lit("")) for c in cells]
        long_field, long_record = too_long(values, s)
        position = lambda tests: F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)], F.lit(None))
        n_fields = _field_counter(s)
        length = lambda test, field_at, kind, message, expected, n: F.when(test, F.struct(field_at.cast("long").alias("field"), F.lit(kind).alias("kind"), F.lit(message).alias("message"), expected.cast("long").alias("expected_len"), n.cast("long").alias("len")))
        none = F.lit(None)
        mended = s.malformed == "repair"
        is_long = [F.octet_length(v) > s.max_field_size for v in values]
        is_bad = [has_replacement(v) for v in values]
        wrong = F.col(_CORRUPT).isNotNull()
        sizes = reduce(lambda a, b: a + b, [F.octet_length(v) for v in values], F.lit(0))
        found = F.array(
            length(wrong, none, "repaired" if mended else "unequal-lengths", "wrong number of fields", F.lit(len(cells)), none),
            length(reduce(lambda a, b: a | b, is_bad, F.lit(False)), position(is_bad), "utf8", "undecodable bytes", none, none),
            length(long_field, position(is_long), "max-field-size", "field too long", F.lit(s.max_field_size), F.greatest(F.lit(0), *[F.octet_length(v) for v in values])),
            length(long_record, none, "max-record-size", "record too long", F.lit(s.max_record_size), sizes),
        )
        each = rows.select("record", F.col(_CORRUPT).alias("raw"), F.explode(F.filter(found, lambda w: w.isNotNull())).alias("w"))
        # Only the first few go on: they are written before their fields are counted in Python.
        first = Scratch(self.spark, "warnings").table(each.orderBy("record", "w.kind").limit(limit), "first")
        length_of = F.when(F.col("w.kind").isin("repaired", "unequal-lengths"), n_fields(F.col("raw"))).otherwise(F.col("w.len"))
        wanted = sorted({r["record"] for r in first.select("record").collect()})
        if wanted and s.encoding in ("utf-8", "us-ascii"):
            first = first.join(positions(self.spark, self.path, s, wanted), "record", "left")
        else:
            first = first.withColumns({"line": F.lit(None).cast("long"), "byte": F.lit(None).cast("long")})
        return first.orderBy("record", "w.kind").select("record", "line", "byte", "w.field", "w.kind", "w.message", "w.expected_len", length_of.alias("len"))


def _field_counter(settings: ParseSettings):
    """Counts the fields of raw malformed records."""
    delimiter, quote, escape = settings.delimiter, settings.quote, settings.escape

    @F.pandas_udf("long")
    def n_fields(raw):
        def count(text):
            if text is None:
                return None
            rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote, doublequote=escape is None, escapechar=escape))
            return len(rows[0]) if rows else 0

        return raw.map(count).astype("Int64")

    return n_fields


def from_table(df: DataFrame, key: str | list[str], fill: bool = True) -> DataFrame:
    """Any DataFrame as row_id and text cells: ids are ranks of a unique key, cells keep their names.

    The rank is found without a global window: the keys alone are range-partitioned and written
    once, and each partition is shifted by the rows before it. Rows meet their ranks in a join on
    the key, so a filter on cells still reaches the scan of ``df``. Null cells become empty ones;
    with ``fill`` off they stay null, which matches the same for any query that is not empty and
    lets comparisons with constants be pushed down as well.
    """
    from tablewright.operators.ordering import dense_rank_ids

    keys = [key] if isinstance(key, str) else key
    ranks = dense_rank_ids(df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]), [F.col(f"__k{i}") for i in range(len(keys))], "row_id")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return df.join(ranks, same).select("row_id", *[_cell(df, c, fill) for c in df.columns])


def _cell(df: DataFrame, name: str, fill: bool) -> Column:
    c = F.col(name) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name).cast("string")
    return (F.coalesce(c, F.lit("")) if fill else c).alias(name)
