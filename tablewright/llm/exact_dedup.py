"""Exact deduplication by stateful streaming.

A first scan turns the table into a slim ingest log: identifier, SHA-256 of the whole
text, its length in bytes and a content locator (file and row within it). A structured stream
reads that log and keeps, per digest, the identifier and locator of the row that stays and the
number of rows seen. The state lives in RocksDB, has no watermark and never expires; it is
read back as a table. The locators find the texts that stay again, and every hit (a digest
seen before) is then confirmed on full bytes against the one text of its group. Only
DataFrame operations run on the executors.

Scale: the log and the state hold about 100 bytes a row and digest. The stream combines
equal digests before its shuffle, so one text copied into a third of all rows is one
state row per map task. Joins from rows to groups have one row per digest on their other
side and compare each row once; a digest with a share of 1 in 65536 of all rows or more, of
which there are at most as many, is dealt to several tasks in proportion to its share.

An input that is not a plain scan of files is written first, as its rows have no locator.

Defined results: a null text counts as empty; rows with equal texts and equal identifiers
are one group of which a single row stays; a null identifier ranks below all others; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.storage import Scratch

#: A digest is heavy with one row in HEAVY or more; it is dealt to one task more for each 1 in DEAL of all rows.
HEAVY, DEAL = 1 << 16, 1 << 10

#: State store settings while a stream starts; a stream keeps the settings it started with.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition reserves megabytes of disk
}

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextlib.contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def is_scan(docs: DataFrame) -> bool:
    """Whether the rows come straight from Parquet files, which can be read again by file and row."""
    plan = docs._jdf.queryExecution().analyzed()
    name = lambda x: x.getClass().getSimpleName()
    return name(plan) == "LogicalRelation" and name(plan.relation()) == "HadoopFsRelation" and name(plan.relation().fileFormat()) == "ParquetFileFormat"


def locator(docs: DataFrame) -> tuple[Column, Column]:
    """Where a row's content is: its file and its place in it. Without a file, a number that only tells rows of one scan apart."""
    if not is_scan(docs):
        return F.lit(None).cast("string").alias("file"), F.monotonically_increasing_id().alias("row_no")
    meta = docs.metadataColumn("_metadata")
    return meta["file_path"].alias("file"), meta["row_index"].alias("row_no")


def ingest_log(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> DataFrame:
    """One slim row per document: what the stream needs to see of it."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), *locator(docs))


def stateful_groups(stream: DataFrame) -> DataFrame:
    """The streaming aggregation: state per digest, without expiry."""
    return stream.groupBy("digest", "n_bytes").agg(
        F.max(F.struct("doc_id", "file", "row_no")).alias("keep"),
        F.count(F.lit(1)).alias("n"),
    )


def run_stream(stream: DataFrame, state_path: str) -> None:
    """Feeds all available input to the state at ``state_path`` and stops; call it again when more has come."""
    with _settings(stream.sparkSession, STATE_CONF):
        query = stateful_groups(stream).writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path).trigger(availableNow=True).start()
    query.awaitTermination()


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The digest state as a table: digest, n_bytes, keep_id, keep_row, keep_file, n."""
    with _settings(spark, STATE_CONF):
        state = spark.read.format("statestore").load(state_path)
        return state.select("key.digest", "key.n_bytes", F.col("value.max.doc_id").alias("keep_id"), F.col("value.max.row_no").alias("keep_row"), F.col("value.max.file").alias("keep_file"), F.col("value.count").alias("n"))


class ExactDedup:
    """Deduplicates one table: ``verdicts`` judges every row, ``survivors`` keeps whole rows."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> None:
        self.spark, self.digest = docs.sparkSession, digest
        self.scratch = Scratch(self.spark, "exact-dedup")
        self.docs = docs = docs if is_scan(docs) else self.scratch.table(docs, "input")
        self.id, self.text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
        self.log = self.scratch.table(ingest_log(docs, id_col, text_col, digest), "log")
        stream = self.spark.readStream.schema(self.log.schema).parquet(self.scratch.at("log"))
        run_stream(stream, self.scratch.at("state"))
        hits = read_state(self.spark, self.scratch.at("state")).filter("n > 1")
        self.hits = self.scratch.table(hits, "hits")
        self.scratch.drop("state")
        total = self.log.count()
        heavy = self.hits.filter(F.col("n") * HEAVY >= total).select("digest", "n_bytes", (1 + F.col("n") * DEAL / max(total, 1)).cast("int").alias("tasks"))
        self.heavy = self.scratch.table(heavy, "heavy")
        self.clashes = self._clashing_digests()

    def _rows(self, *columns: Column) -> DataFrame:
        """Every document with what identifies its text and its place, and more."""
        return self.docs.select(self.id.alias("doc_id"), self.digest(self.text).alias("digest"), F.octet_length(self.text).cast("long").alias("n_bytes"), *locator(self.docs), *columns)

    def _with_groups(self, rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
        """``rows`` joined to one row per digest, heavy digests in several tasks."""
        key = ["digest", "n_bytes"]
        # At most HEAVY rows of some 100 bytes.
        heavy = F.broadcast(self.heavy)
        tasks = F.coalesce("tasks", F.lit(1))
        rows = rows.join(heavy, key, "left").withColumn("task", F.pmod(F.xxhash64("file", "row_no"), tasks).cast("int")).drop("tasks")
        groups = groups.join(heavy, key, "left").withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks")
        return rows.join(groups, [*key, "task"], how).drop("task")

    @staticmethod
    def digest_bucket(digest: Column) -> Column:
        """One of 2^18 buckets: a set of them may be broadcast, whatever the size of the corpus."""
        return F.pmod(F.xxhash64(digest), F.lit(1 << 18)).cast("int")

    def _clashing_digests(self) -> DataFrame | None:
        """Digests whose rows differ in bytes from the row that stays; None if there is no such digest.

        Only texts in buckets that hold a hit are moved; the buckets are at most 2^18 integers.
        """
        bucket = self.digest_bucket(F.col("digest"))
        buckets = self.hits.select(bucket.alias("bucket")).distinct()
        full = self._rows(self.text.alias("body")).withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")
        kept = self.hits.select(F.col("keep_file").alias("file"), F.col("keep_row").alias("row_no"))
        kept = full.join(kept, ["file", "row_no"], "left_semi").select("digest", "n_bytes", F.col("body").alias("kept_body"))
        differ = self._with_groups(full, kept, "inner").filter(F.col("body") != F.col("kept_body"))
        # Written as they are: an aggregate right on the join would tie a hot digest to one task.
        found = self.scratch.table(differ.select("digest", "n_bytes"), "clashes")
        return None if found.isEmpty() else found.distinct()

    def verdicts(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, digest for every row of the table."""
        if self.clashes is not None:
            return self._by_text(self._rows(self.text.alias("body"))).select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), self._stays().alias("kept"), "digest")
        rows = self._with_groups(self.log, self.hits.select("digest", "n_bytes", "keep_id", "keep_row", "keep_file", "n"), "left")
        alone = F.col("n").isNull()
        return rows.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (alone | ((F.col("row_no") == F.col("keep_row")) & (F.col("file") == F.col("keep_file")))).alias("kept"),
            "digest",
        )

    @staticmethod
    def _stays() -> Column:
        return (F.col("row_no") == F.col("keep.row_no")) & (F.col("file") == F.col("keep.file"))

    def _by_text(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``keep`` and ``n`` of their group where digests clash: groups are then formed by the texts themselves."""
        groups = rows.groupBy("digest", "n_bytes", "body").agg(F.max(F.struct("doc_id", "file", "row_no")).alias("keep"), F.count(F.lit(1)).alias("n"))
        return rows.join(self.scratch.table(groups, "groups-by-text"), ["digest", "n_bytes", "body"])

    def survivors(self) -> DataFrame:
        """The rows that stay, with the columns of the input."""
        whole = F.struct("*").alias("row")
        if self.clashes is not None:
            return self._by_text(self._rows(self.text.alias("body"), whole)).filter(self._stays()).select("row.*")
        hits = self.hits.select("digest", "n_bytes", "keep_row", "keep_file")
        rows = self._with_groups(self._rows(whole), hits, "left")
        return rows.filter(F.col("keep_row").isNull() | ((F.col("row_no") == F.col("keep_row")) & (F.col("file") == F.col("keep_file")))).select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text: the one with the largest doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ExactDedup(docs).verdicts().withColumnRenamed("digest", "text_sha256")


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
