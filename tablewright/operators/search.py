"""Searching cells, and moving between matches.

A search is a filter that the scan evaluates; its result is the ids of matching rows. The
optional index holds, for each cell, its lower-cased first bytes; it answers searches that
ignore case in one column with the same rows as a scan, as what the cut could hide is
verified on the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import compared, matches, truncate_utf8
from tablewright.storage import Scratch

#: Bytes of a cell that the index keeps, and kinds of cells beyond which a column is left out.
INDEX_KEY_BYTES, INDEX_MAX_KEYS = 256, 2_000_000


def cell_names(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c != "row_id"]


def predicate(table: DataFrame, query: str, column: int | None = None, *, whole_cell: bool = False, match_case: bool = False) -> Column:
    """A filter for matches in one column by position, or in any. A position out of range matches nothing."""
    cells = cell_names(table)
    if column is not None and not 0 <= column < len(cells):
        return F.lit(False)
    tested = cells if column is None else [cells[column]]
    return reduce(lambda a, b: a | b, [compared(F.col(c), query, whole_cell=whole_cell, match_case=match_case) for c in tested], F.lit(False))


def search(table: DataFrame, query: str, column: int | None = None, *, whole_cell: bool = False, match_case: bool = False) -> DataFrame:
    """row_id of every match."""
    return table.filter(predicate(table, query, column, whole_cell=whole_cell, match_case=match_case)).select("row_id")


def highlights(table: DataFrame, query: str, *, whole_cell: bool = False, match_case: bool = False) -> DataFrame:
    """Which cells of each row match the trimmed query: one boolean ``hit_`` column per cell."""
    wanted = query.strip()
    hits = [(matches(F.col(c), wanted, whole_cell=whole_cell, match_case=match_case) & F.lit(bool(wanted))).alias(f"hit_{c}") for c in cell_names(table)]
    return table.select("row_id", *hits)


def step_match(current: int, n_matches: int, forward: bool = True) -> int | None:
    """The next or previous of ``n_matches``, round the ends; None if there are none."""
    return (current + (1 if forward else -1)) % n_matches if n_matches else None


class SearchIndex:
    """Cells by column and lower-cased key, as a table sorted by both."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table
        cells = cell_names(table)
        each = F.posexplode(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]))
        rows = table.select("row_id", each.alias("column", "cell"))
        lowered = F.lower("cell")
        entries = rows.select("column", truncate_utf8(lowered, INDEX_KEY_BYTES).alias("key"), (F.octet_length(lowered) > INDEX_KEY_BYTES).alias("cut"), "row_id")
        scratch = Scratch(table.sparkSession, "search-index")
        entries = scratch.table(entries, "all")
        sizes = entries.groupBy("column", "key").count().groupBy("column").count().collect()
        self.columns = sorted(r["column"] for r in sizes if r["count"] <= INDEX_MAX_KEYS)
        kept = entries.filter(F.col("column").isin(self.columns)) if self.columns else entries.limit(0)
        self.cut = {r["column"] for r in entries.filter("cut").select("column").distinct().collect()}
        self.entries = scratch.table(kept.repartitionByRange("column", "key", "row_id").sortWithinPartitions("column", "key", "row_id"), "entries")

    def search(self, query: str, column: int, *, whole_cell: bool = False) -> DataFrame:
        """row_id of every match in one column, ignoring case."""
        if column not in self.columns:
            return search(self.table, query, column, whole_cell=whole_cell)
        wanted = F.lower(F.lit(query))
        entries = self.entries.filter(F.col("column") == column)
        short = entries.filter(~F.col("cut") & (F.col("key") == wanted if whole_cell else F.contains("key", wanted))).select("row_id")
        if column not in self.cut:
            return short
        # Cut keys cannot decide: those cells are tested in full.
        cell = cell_names(self.table)[column]
        long = self.table.filter(matches(F.col(cell), query, whole_cell=whole_cell)).filter(F.octet_length(F.lower(F.col(cell))) > INDEX_KEY_BYTES)
        return short.union(long.select("row_id"))


def inverted_index(table: DataFrame, column: int) -> DataFrame:
    """For each lower-cased cell of a column: how many rows have it, the first and the last."""
    key = F.lower(F.col(cell_names(table)[column]))
    return table.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))
