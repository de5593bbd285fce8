"""Edits and deletions over a table that stays as it is, and ranges of selected rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.search import cell_names

Range = tuple[int, int]
EDITS = "row_id long, col_idx int, value string"


def apply_edits(table: DataFrame, edits: DataFrame) -> DataFrame:
    """The table with edited cells replaced, by row id and column position."""
    cells = cell_names(table)
    by_row = edits.groupBy("row_id").agg(*[F.max(F.when(F.col("col_idx") == i, F.col("value"))).alias(f"__e{i}") for i in range(len(cells))])
    return table.join(by_row, "row_id", "left").select("row_id", *[F.coalesce(F.col(f"__e{i}"), F.col(c).cast("string")).alias(c) for i, c in enumerate(cells)])


def without_deleted(table: DataFrame, deletes: DataFrame) -> DataFrame:
    return table.join(deletes.select("row_id"), "row_id", "left_anti")


class Overlay:
    """The pending edits of a session: by original row id, whatever the view shows.

    Deletions are kept as ranges of row ids. A selection in a sorted view may be any set of ids;
    a large one stays a table. Deletions and restorations after such a table are kept in order,
    and the last that has a row decides.
    """

    def __init__(self) -> None:
        self.edits: dict[int, dict[int, str]] = {}
        self._changes: list[tuple[bool, list[Range] | DataFrame]] = []

    @property
    def deleted(self) -> set[int]:
        """The deleted ids, one by one: for few rows."""
        found: set[int] = set()
        for gone, rows in self._changes:
            ids = (i for start, end in rows for i in range(start, end + 1)) if isinstance(rows, list) else (r["row_id"] for r in rows.toLocalIterator())
            found = found.union(ids) if gone else found.difference(ids)
        return found

    def can_edit(self, row_id: int) -> bool:
        for gone, rows in reversed(self._changes):
            if is_selected(rows, row_id) if isinstance(rows, list) else not rows.filter(F.col("row_id") == row_id).isEmpty():
                return not gone
        return True

    def commit(self, row_id: int, col_idx: int, value: str, original: str) -> bool:
        """Sets a cell; back to its original value the edit is gone. Whether anything changed."""
        if not self.can_edit(row_id):
            return False
        row = self.edits.get(row_id, {})
        if value == row.get(col_idx, original):
            return False
        if value == original:
            del row[col_idx]
        else:
            row[col_idx] = value
        if row:
            self.edits[row_id] = row
        else:
            self.edits.pop(row_id, None)
        return True

    def delete(self, row_ids: Iterable[int]) -> None:
        self.delete_rows([(i, i) for i in row_ids])

    def restore(self, row_ids: Iterable[int]) -> None:
        self.restore_rows([(i, i) for i in row_ids])

    def delete_rows(self, rows: Iterable[Range] | DataFrame) -> None:
        """Deletes ranges of row ids, or a table of them."""
        self._change(True, rows)

    def restore_rows(self, rows: Iterable[Range] | DataFrame) -> None:
        self._change(False, rows)

    def _change(self, gone: bool, rows: Iterable[Range] | DataFrame) -> None:
        if isinstance(rows, DataFrame):
            self._changes.append((gone, rows.select("row_id")))
        elif any(isinstance(r, DataFrame) for _, r in self._changes):
            self._changes.append((gone, normalised(rows)))
        else:
            before = self._changes[0][1] if self._changes else []
            now = normalised([*before, *rows]) if gone else subtracted(before, rows)
            self._changes = [(True, now)] if now else []

    def clear(self) -> None:
        self.edits.clear()
        self._changes.clear()

    @property
    def dirty(self) -> bool:
        return bool(self.edits or self._changes)

    def edits_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, c, v) for r, row in self.edits.items() for c, v in row.items()], EDITS)

    def apply(self, table: DataFrame) -> DataFrame:
        if self.edits:
            table = apply_edits(table, self.edits_frame(table.sparkSession))
        return self.kept(table)

    def kept(self, table: DataFrame) -> DataFrame:
        """The rows that are not deleted."""
        if not self._changes:
            return table
        spark, columns = table.sparkSession, table.columns
        if len(self._changes) == 1 and isinstance(rows := self._changes[0][1], list):
            return table.filter(~in_ranges(F.col("row_id"), rows)) if len(rows) <= FEW_RANGES else without_deleted(table, _listed(spark, rows))
        marks, tests = None, []
        for n, (gone, rows) in enumerate(self._changes):
            mark = F.struct(F.lit(n).alias("n"), F.lit(gone).alias("gone"))
            if isinstance(rows, list) and len(rows) <= FEW_RANGES:
                tests.append(F.when(in_ranges(F.col("row_id"), rows), mark))
                continue
            listed = (_listed(spark, rows) if isinstance(rows, list) else rows).select("row_id", mark.alias("__mark"))
            marks = listed if marks is None else marks.union(listed)
        table = table.join(marks.groupBy("row_id").agg(F.max("__mark").alias("__mark")), "row_id", "left")
        last = F.greatest(F.col("__mark"), *tests) if tests else F.col("__mark")
        return table.filter(~F.coalesce(last["gone"], F.lit(False))).select(*columns)


#: Ranges that a filter tests; more are listed id by id and joined.
FEW_RANGES = 200


def _listed(spark: SparkSession, ranges: list[Range]) -> DataFrame:
    return spark.createDataFrame(ranges or [(0, -1)], "start long, end long").filter("start <= end").select(F.explode(F.sequence("start", "end")).alias("row_id"))


# ---- selections: ranges of rows, both ends included


def normalised(ranges: Iterable[Range]) -> list[Range]:
    """In order, with those that touch or overlap made one."""
    out: list[Range] = []
    for start, end in sorted((min(r), max(r)) for r in ranges):
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def is_selected(ranges: Iterable[Range], row: int) -> bool:
    return any(start <= row <= end for start, end in ranges)


def toggled(ranges: Iterable[Range], row: int) -> list[Range]:
    """A row added to the selection, or taken out of it, which may split a range."""
    ranges = normalised(ranges)
    if not is_selected(ranges, row):
        return normalised([*ranges, (row, row)])
    return [part for start, end in ranges for part in ([(start, row - 1), (row + 1, end)] if start <= row <= end else [(start, end)]) if part[0] <= part[1]]


def subtracted(ranges: Iterable[Range], other: Iterable[Range]) -> list[Range]:
    """What is left of the ranges without others."""
    out = normalised(ranges)
    for low, high in normalised(other):
        out = [part for start, end in out for part in ([(start, min(end, low - 1)), (max(start, high + 1), end)] if start <= high and low <= end else [(start, end)]) if part[0] <= part[1]]
    return out


def added(ranges: Iterable[Range], new: Range) -> list[Range]:
    return normalised([*ranges, new])


def in_ranges(row: Column, ranges: Iterable[Range]) -> Column:
    """Membership as a predicate that a scan can evaluate."""
    test = F.lit(False)
    for start, end in normalised(ranges):
        test = test | row.between(start, end)
    return test
