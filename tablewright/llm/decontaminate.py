"""Benchmark decontamination by greedy string tiling.

Tokens are the words of a text in lower case without ASCII punctuation. A document and a
benchmark item that share a seed, a run of ``words`` tokens, are compared: the longest run
that both share and neither has marked becomes a tile, its tokens are marked on both sides,
and so on down to runs of ``words`` tokens. The share of an item's tokens under tiles is its
coverage; from ``threshold`` on the document is contaminated by it. Tiles may come in any
order, so a passage whose sentences were moved about is found as well.

The search for the longest runs is running Karp-Rabin: windows of a search length are hashed by
a rolling polynomial, equal hashes are verified and extended, and the search length falls
from the longest runs to ``words``.

Scale: documents are never shuffled. The benchmark is the stated query set: it is cut into
blocks of at most about ``block_bytes`` of text, each broadcast and held against all
documents in a pass of its own; one pass is the rule. An item can only be covered as far as
its seeds reach, which spares all but real leaks the tiling, and tiling looks only at the
parts of a document that hold seeds.

Defined results: null or empty texts on either side match nothing; an item of fewer tokens
than a seed must occur whole; an item without an identifier counts, as null; repeated items each count; repeated documents are judged
alike; an empty table gives an empty result, an empty benchmark no contamination; other
columns do not matter.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.words import WordHashes, map_batches, ngram_hashes, slices

_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
Tile = tuple[int, int, int]


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    block_bytes: int = 8 << 20


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_PLAIN).split() if text else []


def _windows(values: Sequence[int], marked: Sequence[bool], size: int) -> list[tuple[int, int]]:
    """(hash, start) of every window of unmarked tokens, by a rolling polynomial."""
    found, value, run, lead = [], 0, 0, pow(_BASE, size, 1 << 64)
    for i, x in enumerate(values):
        if marked[i]:
            value = run = 0
            continue
        value, run = (value * _BASE + x) & _MASK, run + 1
        if run > size:
            value = (value - values[i - size] * lead) & _MASK
        if run >= size:
            found.append((value, i - size + 1))
    return found


def tile(item: Sequence[int], doc: Sequence[int], least: int) -> list[Tile]:
    """Greedy tiles (start in item, start in doc, length) of two token sequences, none shorter than ``least``."""
    tiles: list[Tile] = []
    item_marked, doc_marked = [False] * len(item), [False] * len(doc)
    size = max(least, 20)
    while True:
        at = defaultdict(list)
        for value, start in _windows(doc, doc_marked, size):
            at[value].append(start)
        matches, longest = [], 0
        for value, i in _windows(item, item_marked, size):
            for j in at.get(value, ()):
                if i and j and not item_marked[i - 1] and not doc_marked[j - 1] and item[i - 1] == doc[j - 1]:
                    continue  # the run began earlier and has been seen
                n = 0
                while i + n < len(item) and j + n < len(doc) and not item_marked[i + n] and not doc_marked[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n >= size:
                    matches.append((n, i, j))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        cut = 0
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if n < cut:
                break  # what is left of a match that was cut may be longer: search again first
            if any(item_marked[i : i + n]) or any(doc_marked[j : j + n]):
                cut = n
            else:
                item_marked[i : i + n] = [True] * n
                doc_marked[j : j + n] = [True] * n
                tiles.append((i, j, n))
        if cut:
            continue
        if size > 2 * least:
            size //= 2
        elif size > least:
            size = least
        elif not matches:
            return tiles


def _nulls_first(row: tuple) -> tuple:
    return (row[0] is not None, row[0] or 0, *row[1:])


class Benchmark:
    """A block of items with the seeds by which documents find them."""

    def __init__(self, items: Sequence[tuple[int, str | None]], words: int) -> None:
        self.words, hashes = words, WordHashes()
        self.items = [(item_id, hashes.of(tokens(text))) for item_id, text in items]
        self.items = [x for x in self.items if len(x[1])]
        # Seeds by their length: short items have shorter ones.
        grouped = defaultdict(list)
        for n, (_, values) in enumerate(self.items):
            grouped[min(words, len(values))].append(n)
        self.seeds = {size: self._postings(members, size) for size, members in grouped.items()}

    def _postings(self, members: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [ngram_hashes(self.items[n][1], size) for n in members]
        seeds = np.concatenate(found)
        item = np.repeat(members, [len(f) for f in found])
        place = np.concatenate([np.arange(len(f)) for f in found])
        order = np.argsort(seeds, kind="stable")
        return seeds[order], item[order], place[order]

    def covered(self, values: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item_id, coverage) of the items whose coverage by a document reaches the threshold."""
        out = []
        for size, (seeds, items, places) in self.seeds.items():
            windows = ngram_hashes(values, size)
            first, last = np.searchsorted(seeds, windows, "left"), np.searchsorted(seeds, windows, "right")
            hits = np.flatnonzero(last > first)
            if not len(hits):
                continue
            counts = last[hits] - first[hits]
            posting = np.repeat(first[hits], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            at, item, place = np.repeat(hits, counts), items[posting], places[posting]
            order = np.argsort(item, kind="stable")
            at, item, place = at[order], item[order], place[order]
            cuts = [0, *(np.flatnonzero(np.diff(item)) + 1), len(item)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                item_id, wanted = self.items[item[a]]
                if self._reach(place[a:z], size, len(wanted)) < threshold:
                    continue
                doc = self._near(values, np.unique(at[a:z]), size)
                share = sum(n for _, _, n in tile(wanted.tolist(), doc, size)) / len(wanted)
                if share >= threshold:
                    out.append((item_id, share))
        return sorted(out, key=_nulls_first)

    @staticmethod
    def _reach(places: np.ndarray, size: int, n: int) -> float:
        """The share of an item's tokens that lie in any seed found: no coverage is above it."""
        ends = np.zeros(n + 1, dtype=np.int64)
        starts = np.unique(places)
        np.add.at(ends, starts, 1)
        np.add.at(ends, np.minimum(starts + size, n), -1)
        return float((np.cumsum(ends)[:n] > 0).mean())

    @staticmethod
    def _near(values: np.ndarray, at: np.ndarray, size: int) -> list[int]:
        """The tokens of a document that lie in seeds; stretches are kept apart by tokens that nothing equals."""
        keep = np.zeros(len(values) + 1, dtype=np.int64)
        np.add.at(keep, at, 1)
        np.add.at(keep, at + size, -1)
        inside = np.cumsum(keep)[:-1] > 0
        out, before = [], -1
        for i in np.flatnonzero(inside).tolist():
            if before >= 0 and i != before + 1:
                out.append(-1 - i)
            out.append(int(values[i]))
            before = i
        return out


def blocks(benchmark: DataFrame, settings: Settings, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark in blocks of about ``block_bytes``, fetched one at a time; each item is in one."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    n = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // settings.block_bytes + 1
    for b in range(n):
        yield n, Benchmark(sorted(((r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).dropna(subset=["text"]).collect()), key=_nulls_first), settings.words)


def contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and items, an array of (item_id, coverage) that reach the threshold, for every row."""
    settings = settings or Settings()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = None
    for n_blocks, block in blocks(benchmark, settings):
        one = _against(rows, block, settings)
        if n_blocks == 1:
            return one.drop("key")
        found = one if found is None else found.union(one)
    # Rows that share identifier and text have equal items; one key gathers those of all blocks.
    grouped = found.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.count(F.lit(1)).alias("n"))
    return grouped.select("doc_id", F.array_sort("items").alias("items"), F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / n_blocks).cast("int"))).alias("copy")).drop("copy")


def _against(rows: DataFrame, block: Benchmark, settings: Settings) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(block)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))

    def make():
        hashes, items = WordHashes(), held.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"item_id": i, "coverage": c} for i, c in items.covered(hashes.of(tokens(t)), settings.threshold)] for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["doc_id", "key", "items"])

        return each

    keyed = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    return map_batches(keyed, make, "doc_id long, key long, items array<struct<item_id:long,coverage:double>>")


def keep_clean(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, text_col: str = "text") -> DataFrame:
    """The rows whose text no item covers, with all their columns; one pass over the rows for each block."""
    settings = settings or Settings()
    for _, block in blocks(benchmark, settings):
        docs = _clean_of(docs, block, settings, text_col)
    return docs


def _clean_of(docs: DataFrame, block: Benchmark, settings: Settings, text_col: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        hashes, items = WordHashes(), held.value
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([not items.covered(hashes.of(tokens(t)), settings.threshold) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    coverage = F.coalesce(F.array_max("items.coverage"), F.lit(0.0))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.col("items.item_id").alias("items"), coverage.alias("max_coverage"))
