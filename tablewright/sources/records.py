"""Splitting one large file into records in parallel, quoted line breaks included.

A line break ends a record where the number of quotes before it is even. A first pass counts
the quotes of every split; their parities, added up on the driver from one number per
split, tell each split whether it begins inside a quoted cell. A second pass joins lines to
records, whole batches at a time; a record cut by splits leaves a fragment in each, and only
fragments are shuffled. No task reads more than its split.

This needs quotes that are balanced: each that opens or closes a cell, or is doubled inside
one, counts; a lone quote within an unquoted cell does not fit. Text must be UTF-8.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.sources.settings import ParseSettings

_SCHEMA = "file string, start long, seq long, fragment boolean, raw string"


def _quotes(line: Column, settings: ParseSettings) -> Column:
    if settings.escape:
        line = F.regexp_replace(line, F.lit("\\Q" + settings.escape + "\\E."), F.lit(""))
    return F.length(line) - F.length(F.replace(line, F.lit(settings.quote), F.lit("")))


def _lines(spark: SparkSession, path: str, settings: ParseSettings) -> DataFrame:
    lines = spark.read.option("lineSep", _breaks(settings)).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", _quotes(F.col("value"), settings).cast("long").alias("quotes"))


def _breaks(settings: ParseSettings) -> str:
    return "\r" if settings.line_ending == "cr" else "\n"


class _Joiner:
    """Makes records of the lines of one split, some at a time."""

    def __init__(self, split: tuple[str, int], inside: bool, began: int | None, breaks: str) -> None:
        self.split, self.inside, self.breaks = split, inside, breaks
        #: The split in which a cut record began: another one as long as no line has closed it.
        self.began, self.cut = (began, True) if inside else (split[1], False)
        self.seq, self.open = 0, []

    def add(self, lines: pa.Array, quotes: np.ndarray) -> Iterator[pa.RecordBatch]:
        odd = (int(self.inside) + np.cumsum(quotes)) % 2 == 1
        ends = np.flatnonzero(~odd) + 1
        if len(lines):
            self.inside = bool(odd[-1])
        if not len(ends):
            self.open.append(lines)
            return
        held = sum(map(len, self.open))
        whole = pa.concat_arrays([*self.open, lines.slice(0, int(ends[-1]))])
        self.open = [lines.slice(int(ends[-1]))] if ends[-1] < len(lines) else []
        offsets = pa.array(np.concatenate([[0], ends + held]), pa.int32())
        raw = pc.binary_join(pa.ListArray.from_arrays(offsets, whole), self.breaks)
        if self.cut:
            yield self._batch(raw.slice(0, 1), True)
            raw, self.cut, self.began = raw.slice(1), False, self.split[1]
        yield self._batch(raw, False)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            lines = pa.concat_arrays(self.open)
            yield self._batch(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), self.breaks), True)

    def _batch(self, raw: pa.Array, fragment: bool) -> pa.RecordBatch:
        # A fragment carries its place in the record: the split it comes from.
        n = len(raw)
        start, seq = (self.began, np.full(n, self.split[1])) if fragment else (self.split[1], np.arange(self.seq, self.seq + n))
        self.seq += n
        columns = [pa.array([self.split[0]] * n, pa.string()), pa.array(np.full(n, start), pa.int64()), pa.array(seq, pa.int64()), pa.array([fragment] * n, pa.bool_()), raw.cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "start", "seq", "fragment", "raw"])


def split_records(spark: SparkSession, path: str, settings: ParseSettings, keep_ends: bool = False) -> DataFrame:
    """file, start, seq (which order the records) and raw, the text of each record without its line end.

    With ``keep_ends`` a carriage return before a line feed stays in raw.
    """
    if settings.encoding not in ("utf-8", "us-ascii"):
        raise ValueError("records are split in parallel in UTF-8 only")
    breaks, lines = _breaks(settings), _lines(spark, path, settings)
    counts = lines.groupBy("file", "start").agg(F.sum("quotes").alias("n"), (F.max(F.col("quotes") % 2) > 0).alias("odd")).orderBy("file", "start").collect()
    # For each split: whether it begins inside a quoted cell, and the split in which that cell's record began.
    inside, began, splits, file = False, None, {}, None
    for r in counts:
        if r["file"] != file:
            inside, began, file = False, None, r["file"]
        splits[r["file"], r["start"]] = (inside, began)
        # A record still open at the end began here, unless it came in open and no line closed it.
        if not inside or r["odd"]:
            began = r["start"]
        inside = inside != bool(r["n"] % 2)
    held = spark.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = None
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts, quotes = batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(3))
            changes = np.zeros(batch.num_rows, dtype=bool)
            changes[0] = True
            changes[1:] = (starts[1:] != starts[:-1]) | np.asarray(pc.not_equal(files.slice(1), files.slice(0, batch.num_rows - 1)).cast(pa.uint8())).astype(bool)
            cuts = [*np.flatnonzero(changes).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                split = (files[i].as_py(), int(starts[i]))
                if joiner is None or joiner.split != split:
                    if joiner is not None:
                        yield from joiner.end()
                    joiner = _Joiner(split, *held.value[split], breaks)
                yield from joiner.add(batch.column(2).slice(i, j - i), quotes[i:j])
        if joiner is not None:
            yield from joiner.end()

    made = lines.mapInArrow(run, _SCHEMA)
    whole = made.filter("not fragment").select("file", "start", "seq", "raw")
    cut = made.filter("fragment").groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "raw"))).alias("parts"))
    # A record that goes on beyond its split is the last to begin there.
    joined = cut.select("file", "start", F.lit((1 << 62)).alias("seq"), F.array_join("parts.raw", breaks).alias("raw"))
    found = whole.union(joined)
    return found.withColumn("raw", F.regexp_replace("raw", "\r$", "")) if settings.line_ending == "crlf" and not keep_ends else found


def without_mark(records: DataFrame) -> DataFrame:
    """The records that count: without the byte order mark of a file, and without blank lines."""
    raw = F.when((F.col("start") == 0) & (F.col("seq") == 0), F.regexp_replace("raw", "^\ufeff", "")).otherwise(F.col("raw"))
    return records.withColumn("raw", raw).filter(F.length(F.trim("raw")) > 0)


def way(spark: SparkSession, path: str, settings: ParseSettings) -> str:
    """How a large file is best divided: ``lines`` without a quote in it, ``records`` where all quotes fit, else ``whole``.

    Quotes fit where every record is a row of cells that are either quoted from end to end or
    without quotes; then line breaks outside of quotes, and only they, end records.
    """
    quote = settings.quote
    if settings.encoding.startswith("utf-16") or settings.encoding.startswith("utf-32"):
        return "whole"
    if _lines(spark, path, settings).filter(F.contains("value", F.lit(quote))).isEmpty():
        return "lines"
    if settings.encoding not in ("utf-8", "us-ascii") or settings.escape:
        return "whole"
    q, d = ("\\Q" + c + "\\E" for c in (quote, settings.delimiter))
    cell = f"(?:{q}[^{q}]*+{q}|[^{q}{d}]*+)"
    bare = F.replace("raw", F.lit(quote * 2), F.lit(""))
    odd = split_records(spark, path, settings).filter(~F.rlike(bare, F.lit(f"\\A{cell}(?:{d}{cell})*+\\z")))
    return "records" if odd.isEmpty() else "whole"


def _has_mark(spark: SparkSession, uri: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(3)) == codecs.BOM_UTF8
    finally:
        stream.close()


def positions(spark: SparkSession, path: str, settings: ParseSettings, wanted: list[int]) -> DataFrame:
    """record, line (from 1) and byte (from 0) of where some physical records begin, counted within their file."""
    records = split_records(spark, path, settings, keep_ends=True)
    breaks = _breaks(settings)
    sized = records.select("file", "start", "seq", "raw", (F.octet_length("raw") + 1).cast("long").alias("bytes"), (F.length("raw") - F.length(F.replace("raw", F.lit(breaks), F.lit(""))) + 1).cast("long").alias("lines"))
    text = F.when((F.col("start") == 0) & (F.col("seq") == 0), F.regexp_replace("raw", "^\ufeff", "")).otherwise(F.regexp_replace("raw", "\r$", ""))
    sized = sized.withColumn("counts", (F.length(F.trim(text)) > 0).cast("long")).drop("raw")
    sums = sized.groupBy("file", "start").agg(*[F.sum(c).alias(c) for c in ("bytes", "lines", "counts")]).orderBy("file", "start").collect()
    before, file, shifts, total = [0, 0, 0], None, [], 0
    for r in sums:
        if r["file"] != file:
            # Records are numbered over all files, each without its header; bytes and lines begin again.
            # Spark's reader leaves out a byte order mark.
            total, file, before = total + max(before[2] - int(settings.has_headers), 0), r["file"], [3 * _has_mark(spark, r["file"]), 0, 0]
        shifts.append((r["file"], r["start"], before[0], before[1] + 1, total + before[2] - int(settings.has_headers)))
        before = [x + r[c] for x, c in zip(before, ("bytes", "lines", "counts"), strict=True)]
    shift = spark.createDataFrame(shifts, "file string, start long, byte0 long, line0 long, record0 long")
    over = Window.partitionBy("file", "start").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c).over(over), F.lit(0))
    placed = sized.withColumns({"b": run("bytes"), "l": run("lines"), "n": run("counts")}).filter("counts = 1").join(shift, ["file", "start"])
    return placed.select((F.col("record0") + F.col("n")).alias("record"), (F.col("line0") + F.col("l")).alias("line"), (F.col("byte0") + F.col("b")).alias("byte")).filter(F.col("record").isin(wanted))
