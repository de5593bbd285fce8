"""Sorting by one column and paging through the order.

A total order without a global window: rows are range-partitioned by key and id, sorted
within partitions, and written once with their partition and place; adding the sizes of the
partitions before gives every row its place in the whole. Only those sizes, one number per
partition, come to the driver. The written order is the cache that later pages read.

Order is by bytes, case-sensitive; ties go by row id, so it is the same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.paging import FEW_IDS
from tablewright.storage import Scratch

#: Pages that end before this row are taken from the top, without ordering everything.
SHALLOW = 10_000


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dense_rank_ids(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with the 0-based place of each row in the order of ``keys`` as ``name``."""
    ordered = df.repartitionByRange(_partitions(df), *keys).sortWithinPartitions(*keys)
    placed = ordered.withColumns({"__place": F.monotonically_increasing_id(), "__part": F.spark_partition_id()})
    placed = Scratch(df.sparkSession, "order").table(placed, "rows")
    base, shifts = 0, []
    for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("first")).orderBy("__part").collect():
        shifts.append((r["__part"], base - r["first"]))
        base += r["n"]
    shift = df.sparkSession.createDataFrame(shifts, "__part int, __shift long")
    numbered = placed.join(F.broadcast(shift), "__part")
    return numbered.withColumn(name, F.col("__place") + F.col("__shift")).drop("__part", "__place", "__shift")


def sort_order(table: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """(row_id, display_idx) of all rows in the order of a column."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    rows = table.select("row_id", key.alias("__key"))
    first = F.col("__key").asc() if ascending else F.col("__key").desc()
    return dense_rank_ids(rows, [first, F.col("row_id").asc()], "display_idx").select("row_id", "display_idx")


def sorted_page(table: DataFrame, column: str, start: int, count: int, ascending: bool = True, order: DataFrame | None = None) -> DataFrame:
    """display_idx, row_id and the cells of some rows of the order."""
    if order is None and start + count <= SHALLOW:
        key = F.coalesce(F.col(column).cast("string"), F.lit(""))
        by = [key.asc() if ascending else key.desc(), F.col("row_id").asc()]
        top = table.orderBy(*by).limit(start + count)
        # At most SHALLOW rows are left to number.
        numbered = top.withColumn("display_idx", F.row_number().over(Window.orderBy(*by)).cast("long") - 1)
        return numbered.filter(F.col("display_idx") >= start).select("display_idx", "row_id", *[c for c in table.columns if c != "row_id"])
    order = sort_order(table, column, ascending) if order is None else order
    wanted = sorted_ids(order, start, count)
    if count <= FEW_IDS:
        # The ids of a page are few: with them the scan of the table skips what cannot hold them.
        found = [tuple(r) for r in wanted.collect()]
        wanted = table.sparkSession.createDataFrame(found, "display_idx long, row_id long")
        table = table.filter(F.col("row_id").isin([row_id for _, row_id in found]))
    return table.join(wanted, "row_id").select("display_idx", "row_id", *[c for c in table.columns if c != "row_id"])


def sorted_ids(order: DataFrame, start: int, count: int) -> DataFrame:
    """(display_idx, row_id) of some rows of the order."""
    return order.filter((F.col("display_idx") >= start) & (F.col("display_idx") < start + count)).select("display_idx", "row_id")


def display_places(order: DataFrame, row_ids: DataFrame) -> DataFrame:
    """Where rows are shown under an order: the inverse, for some ids."""
    return order.join(row_ids.select("row_id"), "row_id").select("row_id", "display_idx")


@dataclass(frozen=True)
class SortState:
    """The column that the header shows as sorted, and how; none at first."""

    column: int | None = None
    ascending: bool = True

    def clicked(self, column: int, ready: bool = True) -> SortState:
        """Ascending, then descending, then none; nothing until rows are counted."""
        if not ready:
            return self
        if column != self.column:
            return SortState(column, True)
        return SortState(column, False) if self.ascending else SortState()
