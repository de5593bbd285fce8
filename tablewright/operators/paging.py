"""Reading rows by range or by a list of ids."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a page as a viewer asks for them, pages it fetches ahead, rows it keeps, and pages a session remembers.
PAGE_ROWS, PREFETCH_ROWS, KEPT_ROWS, CACHED_PAGES = 800, 12, 9600, 64
#: Ids per part of a streamed result.
ID_CHUNK = 5000
#: Ids that a filter lists.
FEW_IDS = 1000


def page(table: DataFrame, start: int, count: int) -> DataFrame:
    """Rows ``start`` to ``start + count - 1``; none past the end."""
    return table.filter((F.col("row_id") >= start) & (F.col("row_id") < start + count)).orderBy("row_id")


def rows_by_id(table: DataFrame, row_ids: Sequence[int]) -> DataFrame:
    """``position``, row_id and cells for every id asked for, in that order; repeats repeat, unknown ids have null cells."""
    asked = table.sparkSession.createDataFrame(list(enumerate(map(int, row_ids))), "position long, row_id long")
    # A short list is a filter that a scan can push down; a longer one is joined as the planner sees fit.
    wanted = sorted({int(i) for i in row_ids})
    found = table.filter(F.col("row_id").isin(wanted)) if len(wanted) <= FEW_IDS else table.join(asked.select("row_id").distinct(), "row_id", "left_semi")
    return asked.join(found, "row_id", "left").select("position", *table.columns).orderBy("position")


def row_count(table: DataFrame) -> int:
    return table.count()


def id_chunks(found: DataFrame, size: int = ID_CHUNK) -> Iterator[list[int]]:
    """The ids of a match set in ascending order, some at a time; the driver holds one partition of them."""
    part: list[int] = []
    for r in found.select("row_id").orderBy("row_id").toLocalIterator(prefetchPartitions=True):
        part.append(r[0])
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


class PageCache:
    """The pages read last, by (start, count)."""

    def __init__(self, capacity: int = CACHED_PAGES) -> None:
        self.capacity, self.pages = capacity, OrderedDict()

    def get(self, key: tuple[int, int], read: Callable[[], Any]) -> Any:
        if key in self.pages:
            self.pages.move_to_end(key)
            return self.pages[key]
        found = read()
        self.pages[key] = found
        while len(self.pages) > self.capacity:
            self.pages.popitem(last=False)
        return found

    def clear(self) -> None:
        self.pages.clear()
