"""Writing a table as delimited text.

Lines are made by expressions, range-partitioned and sorted by row id, and written by the
cluster. A single file is then put together by streaming the parts, which the driver never
holds; it appears under its name only when it is whole. The text is UTF-8, with a header if
the source had one, and has no line break at its end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import formatted_row
from tablewright.operators.search import cell_names
from tablewright.sources.settings import ParseSettings
from tablewright.storage import hadoop_path


def lines(table: DataFrame, settings: ParseSettings) -> DataFrame:
    """row_id, line: every row as it is written."""
    cells = [F.col(c).cast("string") for c in cell_names(table)]
    return table.select("row_id", formatted_row(cells, settings.delimiter, settings.quote).alias("line"))


def header_line(labels: list[str], settings: ParseSettings) -> str:
    quote = settings.quote
    special = (settings.delimiter, quote, "\n", "\r")
    return settings.delimiter.join(quote + x.replace(quote, quote * 2) + quote if any(s in x for s in special) else x for x in labels)


def save_parts(table: DataFrame, path: str, settings: ParseSettings) -> None:
    """A folder of part files, in the order of their names; without a header."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines(table, settings).repartitionByRange(parts, "row_id").sortWithinPartitions("row_id")
    ordered.select("line").write.mode("overwrite").option("lineSep", settings.output_terminator()).text(path)


def save(table: DataFrame, path: str, settings: ParseSettings, labels: list[str]) -> None:
    """One file with all rows in the order of their ids. The old file, which may be the source, is replaced at the end."""
    spark = table.sparkSession
    work = f"{path}.{uuid.uuid4().hex}"
    save_parts(table, f"{work}-parts", settings)
    system, where = hadoop_path(spark, path)
    _, parts_path = hadoop_path(spark, f"{work}-parts")
    _, made = hadoop_path(spark, work)
    terminator = settings.output_terminator().encode()
    parts = sorted((s for s in system.listStatus(parts_path) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
    copy = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge
    out = system.create(made, True)
    try:
        if settings.has_headers:
            out.write(bytearray(header_line(labels, settings).encode() + (terminator if parts else b"")))
        for n, part in enumerate(parts):
            size = part.getLen() - (len(terminator) if n == len(parts) - 1 else 0)
            source = system.open(part.getPath())
            try:
                copy(source, out, 0, size)
            finally:
                source.close()
    finally:
        out.close()
    replace(system, made, where)
    system.delete(parts_path, True)


def replace(system, made, where) -> None:
    """Gives a finished file the name of another. The other is put aside until that has worked, and put back if it has not."""
    aside = None
    if system.exists(where):
        aside = where.suffix(f".{uuid.uuid4().hex}.old")
        if not system.rename(where, aside):
            raise OSError(f"cannot put {where} aside; the new file is {made}")
    try:
        moved = system.rename(made, where)
    except Exception:
        moved = False
    if not moved:
        back = aside is None or system.rename(aside, where)
        raise OSError(f"cannot name the new file {where}; it is {made}" + ("" if back else f", the old one {aside}"))
    if aside is not None:
        system.delete(aside, False)


def copied_text(rows: DataFrame, settings: ParseSettings, by: str = "row_id") -> str:
    """A selection as text, in the order of ``by``: ``display_idx`` for a sorted view. It must fit the clipboard."""
    cells = [F.col(c).cast("string") for c in rows.columns if c not in ("row_id", "display_idx")]
    made = rows.select(by, formatted_row(cells, settings.delimiter, settings.quote).alias("line")).orderBy(by)
    return settings.output_terminator().join(r["line"] for r in made.collect())
