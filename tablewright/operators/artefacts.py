"""Row tables and orders kept between sessions, found again by what they were made of."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.sources.settings import ParseSettings
from tablewright.storage import hadoop_path, shared_dir

KEEP_DAYS = 3
#: Raised when the reader gives other rows for the same file, so that older copies are not found.
READER = 2


def source_key(spark: SparkSession, path: str, settings: ParseSettings, reading: str = "whole") -> str:
    """Changes with the path, the length, the time of change, every setting and the way the file is divided."""
    system, where = hadoop_path(spark, path)
    status = system.getFileStatus(where)
    return hashlib.sha256(f"{system.makeQualified(where)}|{status.getLen()}|{status.getModificationTime()}|{settings.identity()}|{reading}|{READER}".encode()).hexdigest()[:32]


class Artefacts:
    """Parquet tables below a folder; a table counts only when it was written to its end."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/tablewright-artefacts"

    def path(self, key: str, name: str) -> str:
        return f"{self.root}/{key}/{name}"

    def get(self, key: str, name: str) -> DataFrame | None:
        system, where = hadoop_path(self.spark, self.path(key, name) + "/_SUCCESS")
        return self.spark.read.parquet(self.path(key, name)) if system.exists(where) else None

    def get_or_make(self, key: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if (found := self.get(key, name)) is None:
            make().write.mode("overwrite").parquet(self.path(key, name))
            found = self.spark.read.parquet(self.path(key, name))
        return found

    def rows(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.get_or_make(key, "rows", make)

    def order(self, key: str, column: int, ascending: bool, make: Callable[[], DataFrame]) -> DataFrame:
        """An order belongs to one column and direction."""
        return self.get_or_make(key, f"order-{column}-{'asc' if ascending else 'desc'}", make)

    def prune(self, days: float = KEEP_DAYS, now: float | None = None) -> list[str]:
        """Drops what has not changed for ``days``; the keys that went."""
        system, where = hadoop_path(self.spark, self.root)
        oldest = ((now or time.time()) - days * 86400) * 1000
        gone = []
        for status in system.listStatus(where) if system.exists(where) else []:
            if status.getModificationTime() < oldest:
                gone.append(status.getPath().getName())
                system.delete(status.getPath(), True)
        return gone
