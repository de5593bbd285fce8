"""One open file: what a viewer or a script asks of it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import duplicates, ordering, overlay, paging, search
from tablewright.operators.artefacts import Artefacts, source_key
from tablewright.sources import sink
from tablewright.sources.delimited import Metadata, Source


#: Rows of a selection that the driver may hold one by one.
FEW_ROWS = 100_000


def initial_path(arguments: Sequence[str]) -> str | None:
    """The first argument that names a CSV file."""
    return next((a for a in arguments if a.lower().endswith(".csv")), None)


class TableSession:
    """Opens delimited files and answers for the one opened last."""

    def __init__(self, spark: SparkSession, artefacts: Artefacts | None = None, pending: str | None = None) -> None:
        self.spark, self.artefacts, self.pending = spark, artefacts or Artefacts(spark), pending
        self.pages, self.overlay, self.sort = paging.PageCache(), overlay.Overlay(), ordering.SortState()
        self.indexing = True
        self._forget()

    def _forget(self) -> None:
        self.pages.clear()
        self.overlay.clear()
        self.sort = ordering.SortState()
        self._index: search.SearchIndex | None = None
        self._order: DataFrame | None = None
        self._warnings: list | None = None
        self._table: DataFrame | None = None

    def take_pending_open(self) -> str | None:
        """The path given at launch, once."""
        pending, self.pending = self.pending, None
        return pending

    def load(self, path: str, overrides: dict | None = None, reading: str = "auto") -> Metadata:
        """Opens a file: dialect, labels and an estimate of its rows. Rows are read when first asked for."""
        self.source = Source(self.spark, path, overrides, reading)
        self._forget()
        self.artefacts.prune()
        self.key = source_key(self.spark, path, self.source.settings, self.source.reading)
        return self.source.metadata

    @property
    def table(self) -> DataFrame:
        """All kept rows, from the copy made at first use."""
        if self._table is None:
            self._table = self.artefacts.rows(self.key, self.source.table)
        return self._table

    def view(self) -> DataFrame:
        """The table with pending edits, without deleted rows."""
        return self.overlay.apply(self.table)

    def row_count(self) -> int:
        return paging.row_count(self.table)

    def chunk(self, start: int, count: int) -> list[list[str]]:
        read = lambda: [list(r)[1:] for r in paging.page(self.table, start, count).collect()]
        return self.pages.get((start, count), read)

    def rows_by_id(self, row_ids: Sequence[int]) -> list[list[str]]:
        """Cells of each id in the order asked for; an empty row for an id that does not exist."""
        found = paging.rows_by_id(self.table, row_ids).collect()
        return [[] if r[2] is None else list(r)[2:] for r in found]

    def search(self, query: str, column: int | None = None, whole_cell: bool = False, match_case: bool = False, include_edits: bool = False) -> DataFrame:
        """row_id of matches in the file; with ``include_edits`` in the view."""
        if include_edits:
            return search.search(self.view(), query, column, whole_cell=whole_cell, match_case=match_case)
        if self._index is not None and column is not None and not match_case:
            return self._index.search(query, column, whole_cell=whole_cell)
        return search.search(self.table, query, column, whole_cell=whole_cell, match_case=match_case)

    def search_stream(self, query: str, column: int | None = None, whole_cell: bool = False, match_case: bool = False, group: str = "search") -> Iterator[list[int]]:
        """Ids of matches in parts. A job group lets a newer search cancel this one."""
        self.spark.sparkContext.setJobGroup(group, f"search {query!r}", interruptOnCancel=True)
        return paging.id_chunks(self.search(query, column, whole_cell, match_case))

    def set_indexing(self, on: bool) -> None:
        """Off forgets the index."""
        self.indexing = on
        if not on:
            self._index = None

    def build_index(self) -> None:
        if self.indexing:
            self._index = search.SearchIndex(self.table)

    def duplicates(self, column: int | None = None) -> DataFrame:
        cells = search.cell_names(self.table)
        return duplicates.duplicates(self.table, None if column is None else [cells[column]])

    def duplicates_stream(self, column: int | None = None) -> Iterator[list[int]]:
        return paging.id_chunks(self.duplicates(column))

    def sort_by(self, column: int, ascending: bool = True) -> DataFrame:
        """(row_id, display_idx), kept for pages and later sessions."""
        name = search.cell_names(self.table)[column]
        self._order = self.artefacts.order(self.key, column, ascending, lambda: ordering.sort_order(self.table, name, ascending))
        self.sort = ordering.SortState(column, ascending)
        return self._order

    def clear_sort(self) -> None:
        self._order, self.sort = None, ordering.SortState()

    def sorted_chunk(self, start: int, count: int) -> list[tuple[int, list[str]]]:
        """(row id, cells) of some rows of the sorted view; of the file's order without a sort."""
        if self._order is None:
            return [(r[0], list(r)[1:]) for r in paging.page(self.table, start, count).collect()]
        found = ordering.sorted_page(self.table, "", start, count, order=self._order).orderBy("display_idx")
        return [(r["row_id"], list(r)[2:]) for r in found.collect()]

    def sorted_ids(self, start: int, count: int) -> list[int]:
        if self._order is None:
            return [r["row_id"] for r in paging.page(self.table.select("row_id"), start, count).collect()]
        return [r["row_id"] for r in ordering.sorted_ids(self._order, start, count).orderBy("display_idx").collect()]

    def original_row(self, display_idx: int) -> int | None:
        """The row id shown at a place."""
        return next(iter(self.sorted_ids(display_idx, 1)), None)

    def edit(self, row_id: int, column: int, value: str) -> bool:
        """Sets a cell of the overlay; False for a deleted row or no change."""
        found = self.rows_by_id([row_id])[0]
        return bool(found) and self.overlay.commit(row_id, column, value, found[column])

    def _rows_shown(self, ranges: Sequence[overlay.Range]) -> list[overlay.Range] | DataFrame:
        """The rows at ranges of places: as ranges where they are few or the file's order is shown, else as a table."""
        last = self.row_count() - 1
        ranges = [(start, min(end, last)) for start, end in overlay.normalised(ranges) if start <= last]
        if self._order is None:
            return ranges
        shown = self._order.filter(overlay.in_ranges(F.col("display_idx"), ranges)).select("row_id")
        if sum(end - start + 1 for start, end in ranges) <= FEW_ROWS:
            return [(r["row_id"], r["row_id"]) for r in shown.collect()]
        return shown

    def delete_selection(self, ranges: Sequence[overlay.Range]) -> None:
        """Deletes the rows shown at ranges of places."""
        self.overlay.delete_rows(self._rows_shown(ranges))

    def restore_selection(self, ranges: Sequence[overlay.Range]) -> None:
        self.overlay.restore_rows(self._rows_shown(ranges))

    def copy_selection(self, ranges: Sequence[overlay.Range]) -> str:
        """Rows shown at ranges of places as text: in the order shown, edited, without deleted ones."""
        rows = self.view()
        if self._order is None:
            return sink.copied_text(rows.filter(overlay.in_ranges(F.col("row_id"), ranges)), self.source.settings)
        shown = self._order.filter(overlay.in_ranges(F.col("display_idx"), ranges))
        return sink.copied_text(rows.join(shown, "row_id"), self.source.settings, "display_idx")

    def warnings(self, clear: bool = False) -> list:
        if self._warnings is None:
            self._warnings = self.source.warnings().collect()
        found = self._warnings
        if clear:
            self._warnings = []
        return found

    def save(self, path: str | None = None) -> None:
        """Writes the view in the file's order. Onto the file itself, it is read anew and the overlay is empty; elsewhere the overlay stays."""
        own = path is None or path == self.source.path
        target = path or self.source.path
        sink.save(self.view(), target, self.source.settings, self.source.metadata.headers)
        if own:
            self.load(target, {"has_headers": self.source.settings.has_headers} | (self.source.overrides or {}) | {"encoding": "utf-8"}, self.source.reading)
