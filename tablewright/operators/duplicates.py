"""Rows that occur more than once, whole or in one column.

Hashes are counted first, which combines before it shuffles; only rows whose hash repeats
are compared in full. Those rows are written first: counting them then combines before it
shuffles as well, and both joins back, with one row per group on their other side, stand
alone between exchanges, where adaptive execution splits a group with a great part of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.search import cell_names
from tablewright.storage import Scratch


def duplicates(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """row_id of all members, the first included, of groups of two or more. Absent cells equal each other."""
    columns = list(columns or cell_names(table))
    rows = table.select("row_id", *columns).withColumn("__hash", F.xxhash64(*columns))
    repeated = rows.groupBy("__hash").count().filter("count > 1").select("__hash")
    likely = Scratch(table.sparkSession, "duplicates").table(rows.join(repeated, "__hash", "left_semi"), "likely")
    groups = likely.groupBy("__hash", *columns).count().filter("count > 1").drop("count")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"g.{c}")) for c in columns], F.col("l.__hash") == F.col("g.__hash"))
    return likely.alias("l").join(groups.alias("g"), same, "left_semi").select("l.row_id")
