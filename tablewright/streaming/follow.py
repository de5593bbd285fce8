"""Following a folder that delimited files arrive in: the searches of a table, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.search import predicate
from tablewright.sources.settings import ParseSettings


def follow(spark: SparkSession, folder: str, n_columns: int, settings: ParseSettings, max_files: int = 64) -> DataFrame:
    """A stream of the rows of every file that arrives: its name and cells c0..cN, malformed rows skipped."""
    cells = [f"c{i}" for i in range(n_columns)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "_corrupt"]])
    reader = spark.readStream.schema(schema).options(sep=settings.delimiter, quote=settings.quote, escape=settings.escape or settings.quote, header=settings.has_headers, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", encoding=settings.encoding, multiLine=True, columnPruning=False, maxFilesPerTrigger=max_files)
    rows = reader.csv(folder).filter("_corrupt is null")
    return rows.select(F.col("_metadata.file_name").alias("file"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cells])


def matching(rows: DataFrame, query: str, column: int | None = None, *, whole_cell: bool = False, match_case: bool = False) -> DataFrame:
    """The rows of a stream that match; without state, so late files cost nothing."""
    return rows.filter(predicate(rows.drop("file"), query, column, whole_cell=whole_cell, match_case=match_case))
