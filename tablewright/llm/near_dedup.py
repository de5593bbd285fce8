"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document is the set of its word shingles. Documents with equal sets form one class and go
on as one node, numbered by the class; identifiers are carried beside and only name the
groups at the end. A node's signature has ``trees`` sequences of ``depth`` minima; each
sequence gives one sorted order of all nodes, the leaves of a prefix tree. Candidates are
neighbours in these orders that share a prefix of at least ``min_depth``. The depth adapts
to the region: a node meets all nodes that share its shortest prefix that at most ``dense``
nodes have shared so far. Where even the full depth is denser, as in a family of copies, it
meets those right before it in the order. In every region dense at ``min_depth`` it also
meets the hub, the node that most often lies in the most frequent leaf of such regions: for a
family of copies that is the original, to which each copy is closest.

Every link is confirmed on the full shingle sets of both texts, in rounds: first each
node's best candidate and the hubs, then whatever candidates still join different
components; links within one component could not change the result. In dense regions, where
not all neighbours are candidates, the nodes that are still apart from their hub are the
rest. They are held against the nodes of their own regions in a split join: a region's rest is
cut into blocks that fit into memory, its nodes into runs that pass by, and every block meets
every run in some task, which compares signatures and then full sets. Components come from
alternating stars.

Scale: one scan makes signatures, which are written once. The orders are range-partitioned
by prefix, sequence and node, so a huge region spans many tasks; rows at the ends of
partitions are matched in a small second step, so the cut between tasks loses no pair.
Candidates grow with the number of nodes, never with the square of a group. Only texts of
nodes that have candidates are moved. The split join alone grows with the rest times the nodes
of a region; only confirmed links leave its tasks.

Defined results: a null text counts as empty; an empty document has no shingles and is
linked with nothing; one of fewer words than a shingle is a single shingle; rows that share
a doc_id but not their text are separate documents, and any of them may link; the component
is the smallest doc_id of its rows, null if none of them has one; rows without a doc_id are
compared like others. Of a component the rows whose doc_id is its own are kept; if it has
none, the copies of one text. Rows equal in doc_id and text stay or go together. An empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.graph import components
from tablewright.storage import Scratch
from tablewright.llm.words import WordHashes, as_bytes, lowered_words, map_batches, mixed, shingles, slices


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    trees: int = 16
    depth: int = 8
    min_depth: int = 4
    dense: int = 24
    near: int = 2


def _multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(found: np.ndarray, n: int, block: int = 2048) -> bytes:
    """``n`` minima of a shingle set under as many hash functions, 16 bits each, big-endian so that bytes sort as numbers."""
    by = _multipliers(n)[:, None]
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), block):
        np.minimum(least, (by * found[None, start : start + block]).min(axis=1), out=least)
    return (mixed(least) >> np.uint64(48)).astype(">u2").tobytes()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))


def sketch(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (a hash of identifier and text), n_shingles, digest of the set and signature; the last two null for an empty document."""
    n = settings.trees * settings.depth

    def make():
        hashes = WordHashes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(hashes.of(lowered_words(t)), settings.words) for t in as_bytes(batch.column(2))]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signatures = [signature(s, n) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "key", "n_shingles", "digest", "signature"])

        return each

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), _row_key(docs, id_col, text_col).alias("key"), docs[text_col].cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, key long, n_shingles long, digest binary, signature binary")


def classes_of(sketched: DataFrame) -> DataFrame:
    """node, digest, signature, least (the smallest doc_id) and a row to take the text from, for each different set.

    The node is a number of the class. It must be written before it is used.
    """
    rows = sketched.filter("digest is not null").groupBy("digest").agg(F.first("signature").alias("signature"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "key")).alias("row"))
    return rows.sortWithinPartitions("digest").select(F.monotonically_increasing_id().alias("node"), "digest", "signature", "least", F.col("row.doc_id").alias("row_id"), F.col("row.key").alias("row_key"))


#: Nodes that a task of the split join holds at a time, bytes of their texts, and nodes that pass by it.
HELD, HELD_BYTES, PASSING = 1024, 8 << 20, 1 << 15

PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("node", pa.int64())])


class _Order:
    """Walks one sorted run of (tree, key, node) and gives the neighbours that become candidates."""

    def __init__(self, settings: Settings) -> None:
        self.dense, self.near = settings.dense, settings.near
        #: Bytes of a prefix at every depth, the shortest first, and the first nodes of the region of each.
        self.widths = [2 * d for d in range(settings.min_depth, max(settings.depth, settings.min_depth) + 1)]
        self.tree, self.key = None, b""
        self.heads: list[list[int]] = [[] for _ in self.widths]
        self.sizes = [0] * len(self.widths)
        self.tail: list[int] = []

    def step(self, tree: int, key: bytes, node: int) -> list[tuple[int, int]]:
        """The pairs of this row with rows before it."""
        kept = 0
        if tree == self.tree:
            while kept < len(self.widths) and key[: self.widths[kept]] == self.key[: self.widths[kept]]:
                kept += 1
        for i in range(kept, len(self.widths)):
            self.heads[i], self.sizes[i] = [], 0
        if not kept:
            self.tail = []
        self.tree, self.key = tree, key
        others = self.tail
        for head, size in zip(self.heads, self.sizes, strict=True):
            if size < self.dense:
                others = [x for x in self.tail if x not in head] + head if size else self.tail
                break
        pairs = [(x, node) for x in others if x != node]
        for i, head in enumerate(self.heads):
            if self.sizes[i] < self.dense:
                head.append(node)
            self.sizes[i] += 1
        self.tail = [*self.tail, node][-self.near :]
        return pairs


def _order_pairs(ordered: DataFrame, settings: Settings) -> DataFrame:
    """Candidates a, b within partitions; and, with ``edge`` set, the first and last rows of each partition's end regions."""
    width, keep = 2 * settings.min_depth, settings.dense

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, first, part = _Order(settings), [], 0
        first_region, last_rows = None, []
        for batch in batches:
            trees, keys, nodes = (batch.column(i) for i in range(3))
            part = batch.column(3)[0].as_py() if batch.num_rows else part
            tree, node = np.asarray(trees), np.asarray(nodes)
            key = np.frombuffer(b"".join(keys.to_pylist()), dtype=np.uint8).reshape(len(node), -1) if len(node) else np.empty((0, width), np.uint8)
            prefix = np.ascontiguousarray(key[:, :width])
            same = np.zeros(len(node) + 1, dtype=bool)
            same[1:-1] = (tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1]).all(axis=1)
            # Rows alone in their region are passed over; the ends of a batch may go on in the next.
            busy = same[:-1] | same[1:]
            if len(busy):
                busy[0] = busy[-1] = True
            pairs = []
            for i in np.flatnonzero(busy):
                t, k, x = int(tree[i]), key[i].tobytes(), int(node[i])
                region = (t, k[:width])
                if first_region is None:
                    first_region = region
                if region == first_region and len(first) < keep:
                    first.append((t, k, x))
                last_rows = ([*last_rows, (t, k, x)] if last_rows and (last_rows[-1][0], last_rows[-1][1][:width]) == region else [(t, k, x)])[-keep:]
                pairs += order.step(t, k, x)
            if pairs:
                a, b = zip(*pairs, strict=True)
                none = pa.nulls(len(a))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(none.cast(f.type) for f in list(PAIR)[2:])], schema=PAIR)
        # A region may go on beyond this partition: its last rows here meet the first rows there, even where a whole partition lies between.
        rows = [(part, *r) for r in first] + [(part, *r) for r in last_rows]
        if rows:
            edge, t, k, x = zip(*rows, strict=True)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(edge, pa.int64()), pa.array(t, pa.int32()), pa.array(k, pa.binary()), pa.array(x, pa.int64())], schema=PAIR)

    return ordered.mapInArrow(run, "a long, b long, edge long, tree int, key binary, node long")


def _edge_pairs(edges: DataFrame, settings: Settings) -> DataFrame:
    """Candidates between the end rows of partitions that cut the same region: few rows a partition."""
    from pyspark.sql import Window

    prefix = F.substring("key", 1, 2 * settings.min_depth)
    rows = edges.select("edge", "tree", prefix.alias("prefix"), "key", "node").distinct()
    cut = rows.groupBy("tree", "prefix").agg(F.countDistinct("edge").alias("n"), (F.count(F.lit(1)) > settings.dense).alias("dense")).filter("n > 1").select("tree", "prefix", "dense")
    rows = rows.join(cut, ["tree", "prefix"])
    # All rows of a region that is not dense are here, at most ``dense``: each meets those of every later partition.
    small = rows.filter("not dense").select("tree", "prefix", "edge", "node")
    every = small.withColumnsRenamed({"edge": "before", "node": "a"}).join(small.withColumnRenamed("node", "b"), ["tree", "prefix"]).filter("before < edge and a <> b").select("a", "b")
    rows = rows.filter("dense")
    parts = rows.select("tree", "prefix", "edge").distinct().withColumn("next", F.lead("edge").over(Window.partitionBy("tree", "prefix").orderBy("edge"))).filter("next is not null")
    left = rows.join(parts, ["tree", "prefix", "edge"]).select("tree", "prefix", F.col("next").alias("edge"), F.col("node").alias("a"))
    right = rows.select("tree", "prefix", "edge", F.col("node").alias("b"))
    return every.union(left.join(right, ["tree", "prefix", "edge"]).filter("a <> b").select("a", "b"))


def _hub_pairs(forest: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """Every node of a dense region with the hub of that region."""
    region = ["tree", "prefix"]
    rows = forest.withColumn("prefix", F.substring("key", 1, 2 * settings.min_depth))
    dense = rows.groupBy(*region).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > settings.dense).select(*region)
    rows = scratch.table(rows.join(scratch.table(dense, "dense"), region), "dense-rows")
    leaves = rows.groupBy(*region, "key").agg(F.count(F.lit(1)).alias("n"))
    modes = leaves.groupBy(*region).agg(F.max(F.struct("n", "key")).alias("top")).select(*region, F.col("top.key").alias("key"))
    scores = rows.join(modes, [*region, "key"]).groupBy("node").agg(F.count(F.lit(1)).alias("score"))
    hubs = rows.join(scores, "node").groupBy(*region).agg(F.max(F.struct("score", -F.col("node"))).alias("top"))
    hubs = hubs.select(*region, (-F.col("top.col2")).alias("hub"))
    return rows.join(scratch.table(hubs, "hubs"), region).filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def candidates(nodes: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """a < b, votes (the number of times it was found), hub: each candidate pair of nodes once."""
    width = 2 * settings.depth
    tree = F.explode(F.sequence(F.lit(0), F.lit(settings.trees - 1)))
    forest = nodes.select("node", "signature", tree.alias("tree")).select("tree", F.substring(F.col("signature"), F.col("tree") * width + 1, F.lit(width)).alias("key"), "node")
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = forest.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = scratch.table(_order_pairs(ordered.select("tree", "key", "node", F.spark_partition_id().cast("long").alias("part")), settings), "order-pairs")
    near = found.filter("a is not null").select("a", "b", F.lit(False).alias("hub"))
    ends = _edge_pairs(found.filter("edge is not null"), settings).withColumn("hub", F.lit(False))
    hubs = _hub_pairs(forest, settings, scratch).withColumn("hub", F.lit(True))
    pairs = near.union(ends).union(hubs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "hub")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"), F.max("hub").alias("hub"))
    return scratch.table(pairs, "pairs")


def _bucket(key: Column) -> Column:
    """One of 2^18 buckets: a set of them may be broadcast, whatever the size of the corpus."""
    return F.pmod(key, F.lit(1 << 18)).cast("int")


def _texts_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """node, text of every node with a candidate: the text of one row of its class."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = scratch.table(classes.select("node", "row_id", "row_key").join(nodes, "node"), "pair-nodes")
    buckets = nodes.select(_bucket(F.col("row_key")).alias("bucket")).distinct()
    rows = docs.select(docs[id_col].cast("long").alias("id"), _row_key(docs, id_col, text_col).alias("row_key"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumn("bucket", _bucket(F.col("row_key"))).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")
    found = rows.join(nodes, "row_key").filter(F.col("id").eqNullSafe(F.col("row_id")))
    return scratch.table(found.groupBy("node").agg(F.max("text").alias("text")), "pair-texts")


def confirm(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Those pairs a, b whose full shingle sets are similar enough."""

    def make():
        hashes, kept = WordHashes(), {}

        def found(node: int, text: bytes | None) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[node] = shingles(hashes.of(lowered_words(text)), settings.words)
            return kept[node]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = zip(a, b, as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True)
            return batch.select(["a", "b"]).filter(pa.array([linked(found(x, s), found(y, t), settings.percent) for x, y, s, t in rows], pa.bool_()))

        return each

    rows = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return map_batches(rows.select("a", "b", "text_a", "text_b"), make, "a long, b long")


def _split_links(rows: DataFrame, settings: Settings) -> DataFrame:
    """a < b: links of the rest of dense regions with nodes of their regions in other components.

    ``rows`` has part (a block of some region's rest and a run of its nodes), rest, node,
    component, signature, text. Signatures are compared first. An estimate from n minima has a standard error
    of sqrt(s (1 - s) / n); four of them are allowed for. What is left is compared on the full
    sets at once, so only links leave a task.
    """
    n, share = settings.trees * settings.depth, settings.percent / 100
    least = int(n * (share - 4 * (share * (1 - share) / n) ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        part, held, matrix, sets = None, [], None, {}
        for batch in slices(batches):
            a, b = [], []
            minima = [np.frombuffer(x, dtype=">u2").astype(np.uint16) for x in batch.column(4).to_pylist()]
            for this, rest, node, component, signature, text in zip(*(batch.column(i).to_pylist() for i in range(4)), minima, as_bytes(batch.column(5)), strict=True):
                if this != part:
                    part, held, matrix, sets = this, [], None, {}
                if rest:
                    held.append((node, component, signature, text))
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix, of = np.stack([r[2] for r in held]), np.array([r[1] for r in held], dtype=np.int64)
                mine = None
                for i in np.flatnonzero(((matrix == signature).sum(axis=1) >= least) & (of != component)).tolist():
                    if mine is None:
                        mine = shingles(hashes.of(lowered_words(text)), settings.words)
                    if i not in sets:
                        sets[i] = shingles(hashes.of(lowered_words(held[i][3])), settings.words)
                    if linked(mine, sets[i], settings.percent):
                        a.append(min(node, held[i][0]))
                        b.append(max(node, held[i][0]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("part", "rest", "node", "component", "signature", "text").mapInArrow(run, "a long, b long")


class NearDedup:
    """Groups a table's documents; ``groups`` has one row per document."""

    def __init__(self, docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        settings = settings or Settings()
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        scratch = Scratch(docs.sparkSession, "near-dedup")
        self.sketch = scratch.table(sketch(docs, settings, id_col, text_col), "sketch")
        self.classes = scratch.table(classes_of(self.sketch), "classes")
        pairs = candidates(self.classes.select("node", "signature"), settings, scratch)
        texts = _texts_of(docs, self.classes, pairs, scratch, id_col, text_col)

        both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "votes").union(pairs.select("b", "a", "votes"))
        best = both.groupBy("x").agg(F.max(F.struct("votes", "y")).alias("top")).select(F.least("x", "top.y").alias("a"), F.greatest("x", "top.y").alias("b"))
        first = best.union(pairs.filter("hub").select("a", "b")).distinct()
        links = scratch.table(confirm(first, texts, settings), "links-1").withColumnsRenamed({"a": "u", "b": "v"})
        stars = components(links, scratch, "components-1")

        of = lambda side: stars.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rest = scratch.table(rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "rest")
        more = scratch.table(confirm(rest, texts, settings), "links-2").withColumnsRenamed({"a": "u", "b": "v"})
        links = links.union(more)
        stars = components(links, scratch, "components-2")
        last = self._rest_links(stars, texts, settings, scratch)
        if last is not None:
            stars = components(links.union(last), scratch, "components-3")
        named = self.classes.select("node", "digest", "least", "row_key").join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = scratch.table(named, "named")
        # Without any identifier, the smallest text key stands for the component.
        ids = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("row_key").alias("component_key"))
        self.members = scratch.table(named.select("digest", "component").join(scratch.table(ids, "component-ids"), "component").select("digest", "component_id", "component_key"), "members")

    def _rest_links(self, stars: DataFrame, texts: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame | None:
        """Links of nodes in dense regions that their hubs did not reach; None if there are no such nodes."""
        spark, region = texts.sparkSession, ["tree", "prefix"]
        hubs, rows = (spark.read.parquet(scratch.at(name)) for name in ("hubs", "dense-rows"))
        of = stars.select("node", "component")
        rows = rows.select(*region, "node").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        hubs = hubs.withColumnRenamed("hub", "node").join(of, "node", "left").select(*region, F.coalesce("component", "node").alias("hub_component"))
        rows = scratch.table(rows.join(scratch.table(hubs, "hub-components"), region).withColumn("rest", F.col("component") != F.col("hub_component")).drop("hub_component"), "region-rows")
        if rows.filter("rest").isEmpty():
            return None
        sizes = rows.filter("rest").join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
        sizes = sizes.groupBy(*region).agg((F.greatest(F.count(F.lit(1)) / HELD, F.sum("bytes") / HELD_BYTES).cast("int") + 1).alias("blocks"))
        sizes = rows.groupBy(*region).agg((F.count(F.lit(1)) / PASSING + 1).cast("int").alias("runs")).join(sizes, region)
        rows = rows.join(scratch.table(sizes, "region-sizes"), region)
        number = lambda of_what: F.pmod(F.xxhash64("node", F.lit(7)), F.col(of_what))
        # Every block of a region's rest meets every run of its nodes.
        held = rows.filter("rest").select(*region, "node", "component", F.lit(True).alias("rest"), number("blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs").cast("long") - 1)).alias("run"))
        passing = rows.select(*region, "node", "component", F.lit(False).alias("rest"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), number("runs").alias("run"))
        signed = scratch.table(self.classes.select("node", "signature").join(texts, "node"), "signed")
        met = held.union(passing).withColumn("part", F.xxhash64(*region, "block", "run")).select("part", "rest", "node", "component").join(signed, "node")
        met = met.repartition("part").sortWithinPartitions("part", F.col("rest").desc(), "node")
        return scratch.table(_split_links(met, settings).distinct(), "links-3").withColumnsRenamed({"a": "u", "b": "v"})

    def _judged(self) -> DataFrame:
        """doc_id, key, n_shingles, component_id and whether the rows stay."""
        rows = self.sketch.select("doc_id", "key", "n_shingles", "digest").join(self.members, "digest", "left")
        alone, own = F.col("digest").isNull(), F.col("doc_id").eqNullSafe(F.col("component_id"))
        kept = F.when(alone, F.lit(True)).when(F.col("doc_id").isNull() & F.col("component_id").isNull(), F.col("key") == F.col("component_key")).otherwise(own)
        return rows.select("doc_id", "key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept"))

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
        return self._judged().select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

    def survivors(self) -> DataFrame:
        """The rows of one document per group, with the columns of the input."""
        gone = self._judged().filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("key").alias("__gone_key")).distinct()
        same = (_row_key(self.docs, self.id_col, self.text_col) == gone["__gone_key"]) & self.docs[self.id_col].cast("long").eqNullSafe(gone["__gone"])
        return self.docs.join(gone, same, "left_anti")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies, on shingles of four words."""
    return NearDedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), Settings(words=4)).groups()


OP5_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2], words[i + 3]))) END AS shingles
  FROM cut
), sizes AS (
  SELECT doc_id, len(shingles) AS n FROM sets
), each AS (
  SELECT doc_id, unnest(shingles) AS shingle FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""
