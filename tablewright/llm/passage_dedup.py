"""Substring deduplication: repeated runs of words, wherever in a line they lie.

Digests of whole lines (``line_dedup``) miss passages that begin inside a line and remove
short lines that repeat by chance, so the units here are windows: normalised, hashed, grouped
over the whole corpus, the earliest kept and the rest removed, as there.

A window is ``words`` (50) words in a row, A-Z lower-cased and without the white space
between. Every window that occurs earlier in the corpus is removed, by the order of doc_id,
then of a hash of the row, then of the place in the text; what is removed of a text is the
union of its removed windows. So any run of 50 words or more that repeats is found, with its
exact ends, whether or not it touches a line break. Lines are ``line_dedup``'s.

Not all windows are compared. Each window picks the run of 25 words in it with the smallest
hash (winnowing); equal windows pick equal runs, so only windows whose run repeats matter.
Neighbouring windows with the same pick form a segment. Of segments that are equal as a
whole the earliest is kept and the others go; single windows are compared only between the
earliest copies of different segments with the same pick. This gives the result of comparing
all windows, up to collisions of 128 bits of hashes.

Scale: one scan makes slim rows, about 2 for 27 words, written once. Groupings combine in
each map task; joins back have one row per key on the other side, and adaptive execution
splits a hot one. Texts are shuffled twice: to cut single windows, and for the result.

Defined results: a null text stays null, one of fewer words than a window stays as it is;
rows without a doc_id rank last; rows with equal doc_id and text are one document and are
treated alike; rows are told apart by their doc_id and a 64-bit hash of both; the white space after a removed run goes with it; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.words import WordHashes, as_bytes, lowered_words, map_batches, mixed
from tablewright.storage import Scratch

WORDS = 50
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C17


class Runs:
    """Hashes of runs of words of one text, by sums over a polynomial."""

    _powers = _inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        if len(Runs._powers) <= n:
            size = 2 * n + 1024
            Runs._powers, Runs._inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, dtype=np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * Runs._powers[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each run from ``start`` to before ``end``."""
        return mixed((self.sums[end] - self.sums[start]) * Runs._inverse[start] + (end - start).astype(np.uint64))


def segments(hashes: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(pick, segment, place, first, last) of each segment: two hashes, where the picked run begins, and the first and last window."""
    n, size = len(hashes), words // 2
    if n < words:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    runs, places = Runs(hashes), np.arange(n - size + 1)
    picks = runs.of(places, places + size)
    chosen = np.lib.stride_tricks.sliding_window_view(picks, words - size + 1).argmin(axis=1) + np.arange(n - words + 1)
    cuts = np.flatnonzero(np.diff(chosen)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(chosen)]]) - 1
    place = chosen[first]
    whole = mixed(runs.of(first, last + words) + (place - first).astype(np.uint64))
    return picks[place].view(np.int64), whole.view(np.int64), place, first, last


def removed_spans(text: str, windows: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of runs of words (first, end), joined where they touch, with the white space that follows."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    joined: list[list[int]] = []
    for first, end in sorted(windows):
        if joined and first <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([first, end])
    return [(starts[a], starts[z]) for a, z in joined]


def without(text: str, spans: Sequence[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


class PassageDedup:
    """Finds the repeated passages of a table."""

    def __init__(self, docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.docs = docs
        scratch = Scratch(docs.sparkSession, "passage-dedup")
        self.text = docs[text_col].cast("string")
        self.doc_id = docs[id_col].cast("long")
        self.key = F.xxhash64(self.doc_id, self.text)

        def make():
            hashes = WordHashes()

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [segments(hashes.of(lowered_words(t)), words) for t in as_bytes(batch.column(2))]
                counts = [len(f[0]) for f in found]
                named = [pa.array(np.repeat(np.asarray(batch.column(i)), counts), pa.int64()) for i in range(2)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                return pa.RecordBatch.from_arrays([*named, *(pa.array(np.concatenate(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names=["key", "rank", "pick", "segment", "place", "lo", "hi"])

            return each

        self.rank = F.coalesce(self.doc_id, F.lit(_LAST))
        rows = docs.select(self.key.alias("key"), self.rank.alias("rank"), self.text.alias("text"))
        every = scratch.table(map_batches(rows, make, "key long, rank long, pick long, segment long, place int, lo int, hi int"), "segments")
        repeated = every.groupBy("pick").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("pick")
        # What is joined to is written first: adaptive execution splits a hot key only between two exchanges.
        hot = scratch.table(every.join(scratch.table(repeated, "repeated"), "pick"), "hot")
        scratch.drop("segments")

        copies = hot.groupBy("pick", "segment").agg(F.min(F.struct("rank", "key", "place", "lo", "hi")).alias("first"), F.count(F.lit(1)).alias("n"))
        copies = scratch.table(copies, "copies")
        later = hot.join(copies.filter("n > 1").select("pick", "segment", "first"), ["pick", "segment"]).filter(F.struct("rank", "key", "place") > F.struct("first.rank", "first.key", "first.place"))
        whole = later.select("rank", "key", F.col("lo").alias("first"), (F.col("hi") + words).alias("end"))

        differ = copies.groupBy("pick").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("pick")
        cut = copies.join(scratch.table(differ, "differ"), "pick").select("pick", "first.*").groupBy("rank", "key").agg(F.collect_list(F.struct("pick", "lo", "hi")).alias("parts"))
        cut = rows.join(scratch.table(cut, "cut"), ["rank", "key"])
        windows = scratch.table(map_batches(cut.select("key", "rank", "text", "parts"), _cutter(words), "key long, rank long, pick long, window long, place int"), "windows")
        earliest = windows.groupBy("pick", "window").agg(F.min(F.struct("rank", "key", "place")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        single = windows.join(scratch.table(earliest.select("pick", "window", "first"), "earliest"), ["pick", "window"]).filter(F.struct("rank", "key", "place") > F.col("first"))
        single = single.select("rank", "key", F.col("place").alias("first"), (F.col("place") + words).alias("end"))
        gone = whole.union(single).groupBy("rank", "key").agg(F.collect_set(F.struct("first", "end")).alias("gone"))
        self.gone = scratch.table(gone, "gone")

    def result(self) -> DataFrame:
        """doc_id, removed (array of start, end in code points) and clean_text for every row."""
        rows = self.docs.select(self.rank.alias("rank"), self.key.alias("key"), self.doc_id.alias("doc_id"), self.text.alias("text")).join(self.gone, ["rank", "key"], "left")
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def make():
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts, gone = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                spans = [removed_spans(t, [(w["first"], w["end"]) for w in g]) if g else [] for t, g in zip(texts, gone, strict=True)]
                clean = [without(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], kind), pa.array(clean, pa.string())], names=["doc_id", "removed", "clean_text"])

            return each

        return map_batches(rows.select("doc_id", "text", "gone"), make, "doc_id long, removed array<struct<start:long,end:long>>, clean_text string")


def _cutter(words: int):
    """Cuts the segments of a text into its windows."""

    def make():
        hashes = WordHashes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for key, rank, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                runs = Runs(hashes.of(lowered_words(text)))
                places = np.concatenate([np.arange(p["lo"], p["hi"] + 1) for p in parts])
                picks = np.repeat(np.array([p["pick"] for p in parts], dtype=np.int64), [p["hi"] - p["lo"] + 1 for p in parts])
                for c, x in zip(columns, (np.full(len(places), key), np.full(len(places), rank), picks, runs.of(places, places + words).view(np.int64), places), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds, strict=True)], names=["key", "rank", "pick", "window", "place"])

        return each

    return make


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the passages that are removed of it, and its clean text."""
    found = PassageDedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).result()
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", (F.size("removed") > 0).alias("changed"), F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), "clean_text")


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS pieces,
         length(text) - length(ltrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS lead
  FROM documents
), normal AS (
  SELECT *, list_transform(pieces, lambda p: translate(regexp_replace(p, '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words
  FROM docs
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, unnest(list_transform(range(1, len(words) - 48), lambda i: md5(array_to_string(words[i:i + 49], ' ')))) AS digest
  FROM normal WHERE len(words) >= 50
), gone AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id, i) > 1
), marked AS (
  SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS begins FROM gone
), numbered AS (
  SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), runs AS (
  SELECT doc_id, run, min(i) AS first, max(i) + 49 AS last FROM numbered GROUP BY doc_id, run
), tokens AS (
  SELECT doc_id, lead, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS n FROM normal
), placed AS (
  SELECT *, lead + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tokens
), spans AS (
  SELECT doc_id, run, min(start) AS start, max(start + length(piece)) AS stop FROM placed JOIN runs USING (doc_id) WHERE n BETWEEN first AND last GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY n) AS clean FROM placed ANTI JOIN spans ON placed.doc_id = spans.doc_id AND placed.start >= spans.start AND placed.start < spans.stop GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(start || ':' || stop, ',' ORDER BY start) AS removed FROM spans GROUP BY doc_id
)
SELECT d.doc_id, l.n IS NOT NULL AS changed, coalesce(l.n, 0) AS n_removed, coalesce(l.removed, '') AS removed,
       CASE WHEN l.n IS NULL THEN d.text ELSE left(d.text, d.lead) || coalesce(k.clean, '') END AS clean_text
FROM docs d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
