"""Deduplication of whole lines or paragraphs by hashing; ``passage_dedup`` finds what lies inside them.

A unit is a line (or a paragraph) of at least ``min_words`` words. Units are normalised
(lower case, white space collapsed) and hashed to 128 bits; over the whole corpus the
occurrence in the smallest doc_id, and in it the first, is kept and every other one is
removed. Spans of what is removed are code-point offsets into the source text, end
exclusive; the clean text is what remains, its units joined as before.

Scale: one scan makes slim rows (digest, identifier, offsets), written once. The grouping
combines within each map task first, so one line in a third of all documents is one row a
task; the join back to the few repeated digests has one row per digest on its other side,
and adaptive execution splits a hot digest. Spans are collected per document only.

Defined results: a null or empty text has no units and stays as it is; rows with a null
doc_id rank last; rows that share a doc_id rank equal, so each keeps the first occurrence;
shorter lines and blank lines are never removed; an empty table gives an empty result;
other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.storage import Scratch
from tablewright.llm.words import map_batches

MIN_WORDS = 10
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_LAST = (1 << 63) - 1


def units(text: str | None, separator: str, min_words: int) -> list[tuple[bytes, int, int, bool]]:
    """(digest, start, end, seen before in this text) of each unit that counts."""
    found, seen, start = [], set(), 0
    for part in (text or "").split(separator):
        if len(part) >= 2 * min_words - 1:
            words = [w for w in _SPACE.split(part.lower()) if w]
            if len(words) >= min_words:
                digest = xxhash.xxh3_128_digest(" ".join(words).encode())
                found.append((digest, start, start + len(part), digest in seen))
                seen.add(digest)
        start += len(part) + len(separator)
    return found


def cleaned(text: str, removed: list[tuple[int, int]], separator: str) -> str:
    """The text without the removed units and the separators that follow them."""
    starts, at, kept = {s for s, _ in removed}, 0, []
    for part in text.split(separator):
        if at not in starts:
            kept.append(part)
        at += len(part) + len(separator)
    return separator.join(kept)


class LineDedup:
    """Finds the repeated units of a table."""

    def __init__(self, docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.docs, self.separator = docs, SEPARATORS[unit]
        separator = self.separator
        scratch = Scratch(docs.sparkSession, "line-dedup")
        self.text = docs[text_col].cast("string")
        self.doc_id = docs[id_col].cast("long")
        self.rank = F.coalesce(self.doc_id, F.lit(_LAST))
        self.key = F.xxhash64(self.doc_id, self.text)

        def make():
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows = [(k, r, *u) for k, r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for u in units(t, separator, min_words)]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["key", "rank", "digest", "start", "end", "again"])

            return each

        source = docs.select(self.key.alias("key"), self.rank.alias("rank"), self.text.alias("text"))
        found = map_batches(source, make, "key long, rank long, digest binary, start long, end long, again boolean")
        self.units = scratch.table(found, "units")
        repeated = self.units.groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        self.repeated = scratch.table(repeated, "repeated")
        gone = self.units.join(self.repeated, "digest").filter("again or rank > first")
        spans = gone.groupBy("rank", "key").agg(F.sort_array(F.collect_set(F.struct("start", "end", F.col("first").alias("kept_in")))).alias("removed"))
        self.spans = scratch.table(spans, "spans")

    def result(self) -> DataFrame:
        """doc_id, removed (array of start, end, kept_in: the doc_id that keeps the unit; null if that is null) and clean_text for every row."""
        separator = self.separator
        rows = self.docs.select(self.rank.alias("rank"), self.key.alias("key"), self.doc_id.alias("doc_id"), self.text.alias("text")).join(self.spans, ["rank", "key"], "left")

        def make():
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts, removed = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                clean = [cleaned(t, [(s["start"], s["end"]) for s in r], separator) if r else t for t, r in zip(texts, removed, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(clean, pa.string())], names=["doc_id", "removed", "clean_text"])

            return each

        spans = F.coalesce(F.transform("removed", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.nullif(s["kept_in"], F.lit(_LAST)).alias("kept_in"))), F.array().cast("array<struct<start:long,end:long,kept_in:long>>"))
        return map_batches(rows.select("doc_id", "text", spans.alias("removed")), make, "doc_id long, removed array<struct<start:long,end:long,kept_in:long>>, clean_text string")


def long_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines of ten or more words that are removed of it, where they are kept, and its clean text."""
    return _listed(LineDedup(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def every_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every line that is not blank is a unit, however short."""
    return _listed(LineDedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=1))


def _listed(lines: LineDedup) -> DataFrame:
    found = lines.result()
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    kept_in = F.array_join(F.transform("removed", lambda s: s["kept_in"].cast("string")), ",")
    return found.select("doc_id", (F.size("removed") > 0).alias("changed"), F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), kept_in.alias("kept_in"), "clean_text")


LONG_LINE_SQL = r"""
WITH parts AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), lines AS (
  SELECT *, coalesce(sum(length(part) + 1) OVER (PARTITION BY rid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         list_filter(regexp_split_to_array(lower(part), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM parts
), counted AS (
  SELECT *, CASE WHEN len(words) >= 10 THEN array_to_string(words, ' ') END AS unit FROM lines
), ranked AS (
  SELECT *, unit IS NOT NULL AND row_number() OVER (PARTITION BY unit ORDER BY doc_id, n) > 1 AS gone,
         min(doc_id) OVER (PARTITION BY unit) AS kept_in
  FROM counted
)
SELECT any_value(doc_id) AS doc_id, bool_or(gone) AS changed, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(start || ':' || (start + length(part)), ',' ORDER BY n) FILTER (WHERE gone), '') AS removed,
       coalesce(string_agg(kept_in, ',' ORDER BY n) FILTER (WHERE gone), '') AS kept_in,
       coalesce(string_agg(part, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS clean_text
FROM ranked GROUP BY rid
"""

EVERY_LINE_SQL = LONG_LINE_SQL.replace("len(words) >= 10", "len(words) >= 1")
