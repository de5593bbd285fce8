"""An interpolated modified Kneser-Ney model, of word pairs unless a higher order is asked for.

Counting runs in Spark in passes that each end in sorted arrays on shared storage:

1. words: hashes of all training words with their counts. A word's place in the sorted
   array is its id.
2. pairs: an id pair is packed into 64 bits and scrambled by a bijection, which serves as its
   hash and can be undone. Keys are sorted, with counts beside them, in 32 bits where all of a
   bucket fit, else in 64. With 2^32 words or more a pair does not fit; its key is then a
   64-bit hash, and both ids travel beside it while pairs are counted.
3. contexts: for each word the number of tokens and of kinds of pairs it begins, and the
   number of kinds it ends.

An order n above 2 repeats 2 for every length up to n: a run of k words is the pair of the
id of its first k - 1 words and the id of its last, with the id of its last k - 1 words beside it
while it is counted. Then 3 goes down from n - 1 to 1: shorter runs count by the kinds of words
before them, or as often as they occur if they begin a text.

Every array is cut into buckets by the leading bits of the hash, one file each, so a bucket is
made by one task and found without a search. Tasks count what they have read before it is
shuffled, as blocks of sorted, delta-coded keys per bucket; a word pair in a third of all
texts is one entry per block. Hashes spread evenly, so no bucket is hot. The driver sees one
small row per bucket.

Scoring maps whole texts without shuffle. Workers map the arrays into memory and look up
sorted batches, so a model larger than memory is paged in where it is needed. A worker keeps
a bounded number of arrays mapped and lets go of the one it used least recently. From a store
that cannot be mapped it reads an array into memory and keeps a bounded number of bytes;
nothing is written to local disk.

p(w | u) is the discounted share of w among what follows u, plus u's left-over mass times
p(w | u without its first word); for no u at all, the share of w among kinds of pairs that end in it, discounted
likewise, plus the rest spread evenly over the words known and one unknown word. The three discounts of each level
come from the counts of counts. Tokens are words, A-Z lower-cased and split at ASCII white
space, then one end; the first word follows a start mark.

Files are written under a temporary name and renamed, so a task that is run again after its
executor was lost leaves the same file.

Defined results: a null or empty text has only its end; a null doc_id is a training document;
repeated rows count as often as they occur; without training documents every probability is
that of the unknown word; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.storage import Scratch, hadoop_path, remove
from tablewright.llm.words import WordHashes, as_bytes, lowered_words, map_batches, mixed, slices

FOLDS, HELD_OUT_FOLD = 7, 2
#: Marks hold white space, so no word of a text has their hashes.
START, END = (xxhash.xxh3_64_intdigest(mark) for mark in (b" start", b" end"))
#: Tokens that a task gathers before it counts them.
GATHER = 1 << 21
#: Tokens per bucket that a task merges.
TOKENS_PER_BUCKET = 4_000_000
#: Words below which the ids of a pair fit into 64 bits.
NARROW = 1 << 32
#: The largest count that a file of 32-bit counts holds.
LARGEST = (1 << 31) - 1
#: From Python 3.13 on a mapping needs no open file.
_FREE = {"trackfd": False} if sys.version_info >= (3, 13) else {}
#: Arrays that a worker keeps mapped, a quarter of what systems allow, and bytes of arrays that it keeps read.
MAPPED, READ_BYTES = 16_000 if _FREE else 256, 256 << 20
_MASK = (1 << 64) - 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


# ---- arrays on shared storage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Hadoop writes it, and the path in it."""
    for name in ("s3a://", "s3n://"):
        path = "s3://" + path.removeprefix(name) if path.startswith(name) else path
    return fs.FileSystem.from_uri(path)


def write_array(path: str, values: np.ndarray) -> None:
    """Writes to a temporary name first: a reader sees the whole file or none."""
    system, where = located(path)
    system.create_dir(os.path.dirname(where), recursive=True)
    part = f"{where}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(values.tobytes())
    system.move(part, where)


def map_array(path: str, kind: str) -> np.ndarray:
    """The array, mapped into memory; from a store that cannot be mapped, read into it."""
    if urlparse(path).scheme in ("", "file"):
        with open(urlparse(path).path, "rb") as held:
            if not os.fstat(held.fileno()).st_size:
                return np.empty(0, dtype=kind)
            return np.frombuffer(mmap.mmap(held.fileno(), 0, access=mmap.ACCESS_READ, **_FREE), dtype=kind)
    system, where = located(path)
    with system.open_input_stream(where) as source:
        return np.frombuffer(source.read(), dtype=kind)


# ---- blocks of sorted keys and sums, as they are shuffled


def packed(keys: np.ndarray, sums: np.ndarray) -> bytes:
    """Sorted keys as differences and their columns of sums, byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = [steps.view(np.uint8).reshape(-1, 8).T.tobytes(), np.ascontiguousarray(sums.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes()]
    return zstandard.compress(np.array([len(keys), sums.size], dtype="<i8").tobytes() + b"".join(planes), 1)


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(block)
    n, m = np.frombuffer(raw, dtype="<i8", count=2)
    plane = lambda start, size: np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, offset=start, count=8 * size).reshape(8, size).T).view("<u8").ravel()
    keys = np.cumsum(plane(16, n), dtype=np.uint64)
    return keys, plane(16 + 8 * n, m).view("<i8").reshape(n, -1)


def summed(keys: np.ndarray, sums: np.ndarray, beside: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their rows; the last ``beside`` columns are the same in all rows of a key and stay."""
    if not len(keys):
        return keys, sums
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = sums.shape[1] - beside
    return keys[first], np.column_stack([np.add.reduceat(sums[:, :n], first, axis=0), sums[first, n:]])


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Equal ranges of the hash space, so buckets in order hold keys in order."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def blocks(keys: np.ndarray, sums: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, block) for every bucket; ``buckets`` does not decrease."""
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts, ends = [0, *cuts] if len(keys) else [], [*cuts, len(keys)] if len(keys) else []
    rows = [packed(keys[a:b], sums[a:b]) for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([int(buckets[a]) for a in starts], pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "block"])


def merge(rows: DataFrame, n_buckets: int, finish: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, beside: int = 0) -> DataFrame:
    """Brings the blocks of each bucket together and hands its keys and sums to ``finish``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, sums, waiting = None, [], [], 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate(keys), np.concatenate(sums), beside)

        for batch in slices(batches, 64):
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and bucket is not None:
                    yield from finish(bucket, *joined())
                    keys, sums, waiting = [], [], 0
                bucket = b
                k, s = unpacked(block)
                keys.append(k)
                sums.append(s)
                waiting += len(k)
                if waiting > TOKENS_PER_BUCKET:
                    k, s = joined()
                    keys, sums, waiting = [k], [s], 0
        if bucket is not None:
            yield from finish(bucket, *joined())

    return rows.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


# ---- the model


@dataclass(frozen=True)
class Level:
    """Runs of 2 or more words: where the ids of each bucket start, whether keys are hashes, and their discounts."""

    starts: np.ndarray
    wide: bool
    discounts: tuple[float, ...]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that scoring needs beside them."""

    path: str
    n_buckets: int
    starts: np.ndarray
    n_tokens: int
    n_words: int
    grams: tuple[Level, ...]
    word_discounts: tuple[float, ...]
    n_kinds: int
    word_rest: float

    @property
    def wide(self) -> bool:
        return self.grams[0].wide


def discounts(n: list[int]) -> tuple[float, ...]:
    """Discounts for counts 0, 1, 2 and 3 or more from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not n1:
        return 0.0, 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return 0.0, *(min(max(d, 0.05), most) for d, most in zip(raw, (1.0, 2.0, 3.0), strict=True))


def keys_of(k: int) -> str:
    """The array of the keys of runs of ``k`` words."""
    return "words" if k == 1 else "pairs" if k == 2 else f"runs-{k}"


def counts_of(k: int) -> str:
    return "counts" if k == 1 else "pair-counts" if k == 2 else f"run-counts-{k}"


def followers_of(k: int) -> str:
    return "followers" if k == 1 else f"followers-{k}"


def kinds_of(k: int) -> str:
    return "kinds" if k == 1 else f"kinds-{k}"


class Arrays:
    """The mapped arrays of a model, bucket by bucket; those used last stay mapped."""

    KINDS = {"words": "<u8", "counts": "<i8", "pairs": "<u8", "pair-counts": "<i4", "followers": "<i8", "kinds": "<i8"}

    def __init__(self, path: str, n_buckets: int, starts: np.ndarray, mapped: int = MAPPED, read_bytes: int = READ_BYTES) -> None:
        self.path, self.n_buckets, self.starts = path, n_buckets, starts
        self.mapped, self.read_bytes, self.held = mapped, read_bytes, 0
        self.open: OrderedDict[tuple[str, int], np.ndarray] = OrderedDict()

    def get(self, name: str, bucket: int) -> np.ndarray:
        key = (name, bucket)
        if key in self.open:
            self.open.move_to_end(key)
            return self.open[key]
        plain = name.removesuffix("-below")
        runs = "pairs" if plain == "pair-counts" else plain.replace("run-counts", "runs") if plain.startswith("run-counts") else None
        found = map_array(f"{self.path}/{name}/{bucket}", "<u1" if runs else "<u8" if name.startswith("runs") else self.KINDS.get(name, "<i8"))
        if runs:
            # Counts have the width that the largest of the bucket needs.
            n = len(self.get(runs, bucket))
            found = found.view("<i8" if n and len(found) == 8 * n else "<i4")
        self.open[key] = found
        self.held += self._read(found)
        while len(self.open) > self.mapped or (self.held > self.read_bytes and len(self.open) > 1):
            self.held -= self._read(self.open.popitem(last=False)[1])
        return found

    @staticmethod
    def _read(array: np.ndarray) -> int:
        held = array
        while isinstance(held, np.ndarray):
            held = held.base
        return 0 if isinstance(held, mmap.mmap) else array.nbytes

    def word_ids(self, words: np.ndarray) -> np.ndarray:
        """Ids of sorted word hashes; -1 for those that are unknown."""
        ids = np.full(len(words), -1, dtype=np.int64)
        for b, a, z in self._runs(words):
            known = self.get("words", b)
            at = np.searchsorted(known, words[a:z])
            at[at == len(known)] = 0
            found = known[at] == words[a:z] if len(known) else np.zeros(z - a, dtype=bool)
            ids[a:z][found] = self.starts[b] + at[found]
        return ids

    def _runs(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        buckets = bucket_of(keys, self.n_buckets)
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(keys)] if len(keys) else []
        return ((int(buckets[a]), a, z) for a, z in zip(cuts, cuts[1:], strict=False))

    def by_id(self, name: str, ids: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """Rows of an array for sorted ids of words, or of those runs whose buckets start at ``starts``."""
        starts = self.starts if starts is None else starts
        wide = 3 if name.startswith("kinds") else 2 if name.startswith("followers") else 1
        out = np.zeros((len(ids), wide), dtype=np.int64)
        buckets = np.searchsorted(starts, ids, side="right") - 1
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(ids)] if len(ids) else []
        for a, z in zip(cuts, cuts[1:], strict=False):
            b = int(buckets[a])
            out[a:z] = self.get(name, b).reshape(-1, wide)[ids[a:z] - starts[b]]
        return out

    def runs(self, k: int, level_starts: np.ndarray, keys: np.ndarray, top: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of sorted keys of runs of ``k`` words; -1 and 0 for runs never seen. Without ``top`` nothing is counted."""
        counted = counts_of(k) if top else f"{counts_of(k)}-below"
        ids, counts = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for b, a, z in self._runs(keys):
            known = self.get(keys_of(k), b)
            if len(known):
                at = np.searchsorted(known, keys[a:z])
                at[at == len(known)] = 0
                found = known[at] == keys[a:z]
                ids[a:z] = np.where(found, level_starts[b] + at, -1)
                if top is not None:
                    counts[a:z] = np.where(found, self.get(counted, b)[at], 0)
        return ids, counts


def _longer(arrays: Arrays, levels: Sequence[tuple[np.ndarray, bool]], ids: np.ndarray, ends: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length k from 2 to one more than ``levels`` know: the ids of the k - 1 words before each token, and of the
    k - 1 words that end in it; -1 for none.

    ``ids`` are those of the tokens and ``start`` of the mark; ``levels`` has, for the lengths known, where ids start and
    whether keys are hashes.
    """
    here, mark = ids, start
    for k in range(2, len(levels) + 3):
        # What comes before the first token is the mark where runs are words; of longer ones there is none.
        before = _before(here, ends, mark)
        yield before, here
        if k == len(levels) + 2:
            return
        starts, wide = levels[k - 2]
        both, now = (before >= 0) & (ids >= 0), np.full(len(ids), -1, dtype=np.int64)
        if both.any():
            keys, back = np.unique(pair_keys(before[both], ids[both], wide), return_inverse=True)
            now[both] = arrays.runs(k, starts, keys)[0][back]
        here, mark = now, -1


def pair_keys(first: np.ndarray, second: np.ndarray, wide: bool = False) -> np.ndarray:
    """Keys of pairs of ids: a bijection below 2^32 ids, else a hash."""
    first, second = first.astype(np.uint64), second.astype(np.uint64)
    return mixed(mixed(first + np.uint64(1)) + second) if wide else mixed(first << np.uint64(32) | second)


def _unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mixed``."""
    back = lambda v: np.uint64(pow(v, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(33))) * back(0xC4CEB9FE1A85EC53)
    x = (x ^ (x >> np.uint64(33))) * back(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _gathered(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, where each text ends) of some texts at a time, every text closed by END."""
    hashes = WordHashes()
    parts, ends, n = [], [], 0
    for batch in slices(batches):
        for text in as_bytes(batch.column(column)):
            words = hashes.of(lowered_words(text))
            parts += [words, np.array([END], dtype=np.uint64)]
            n += len(words) + 1
            ends.append(n)
            if n >= GATHER:
                yield np.concatenate(parts), np.array(ends)
                parts, ends, n = [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(ends)


def _before(tokens: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """For each token the one before it; START for the first of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.concatenate([[0], ends[:-1]])] = start
    return out


def _fill(path: str, names: tuple[str, ...], made: set[int], n_buckets: int) -> None:
    """Empty files for buckets that no key fell into, so that a missing file is always an error."""
    for bucket in set(range(n_buckets)) - made:
        for name in names:
            write_array(f"{path}/{name}/{bucket}", np.empty(0, dtype="<u1"))


def train(texts: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Counts the texts of a table into a model on shared storage, of runs of up to ``order`` words."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = texts.sparkSession
    scratch = Scratch(spark, "ngram-lm")
    # With its scheme: workers do not know Spark's default file system.
    system, where = hadoop_path(spark, scratch.at("model"))
    path = system.makeQualified(where).toString()
    rows = texts.select(texts[text_col].cast("string").alias("text"))
    # A first guess of the number of tokens from the bytes, for the number of buckets.
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(parts, n_bytes // (6 * TOKENS_PER_BUCKET) + 1)

    def words(batches):
        for tokens, _ in _gathered(batches):
            keys, n = np.unique(tokens, return_counts=True)
            keys, n = np.append(keys, np.uint64(START)), np.append(n, 0)
            keys, n = summed(keys, n[:, None])
            yield blocks(keys, n, bucket_of(keys, n_buckets))

    def keep_words(bucket, keys, sums):
        write_array(f"{path}/words/{bucket}", keys.astype("<u8"))
        write_array(f"{path}/counts/{bucket}", sums[:, 0].astype("<i8"))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (bucket, len(keys), int((sums[:, 0] > 0).sum()), int(sums.sum()))], names=["bucket", "n", "known", "tokens"])

    stats = merge(rows.mapInArrow(words, "bucket long, block binary"), n_buckets, keep_words, "bucket long, n long, known long, tokens long").collect()
    _fill(path, ("words", "counts"), {r["bucket"] for r in stats}, n_buckets)
    sizes = [_sizes(stats, n_buckets)]
    starts = _starts(sizes[0])
    n_words, n_tokens = sum(r["known"] for r in stats), sum(r["tokens"] for r in stats)

    # Up: the runs of every length, with what they tell of the runs one word shorter.
    levels: list[tuple[np.ndarray, bool]] = []
    for k in range(2, order + 1):
        wide = bool(max(sizes[0].sum(), sizes[-1].sum()) >= NARROW)
        counted = _count_runs(rows, path, n_buckets, starts, tuple(levels), _starts(sizes[-1]), k, wide, k == order)
        counted = scratch.table(counted, f"runs-{k}")
        stats = counted.filter("block is null").select("bucket", "n", "n1", "n2", "n3", "n4").collect()
        _fill(path, (keys_of(k), counts_of(k), *(() if k == order else (f"contexts-{k}",))), {r["bucket"] for r in stats}, n_buckets)
        sizes.append(_sizes(stats, n_buckets))
        levels.append((_starts(sizes[-1]), wide))
    found = [discounts([sum(r[f"n{i}"] for r in stats) for i in range(1, 5)])]

    # Down: the contexts of every length, and the counts of shorter runs that follow from them.
    below = None
    for k in range(order - 1, 0, -1):
        told = spark.read.parquet(scratch.at(f"runs-{k + 1}")).filter("block is not null").select("bucket", "block")
        told = told if below is None else told.union(below.filter("block is not null").select("bucket", "block"))
        if k > 1:
            # Runs that are whole texts tell nothing of each other: every bucket gets one row of zeros at least.
            firsts = [(b, bytearray(packed(levels[k - 2][0][b : b + 1].astype(np.uint64), np.zeros((1, 5), dtype=np.int64)))) for b in np.flatnonzero(sizes[k - 1]).tolist()]
            told = told.union(spark.createDataFrame(firsts, "bucket long, block binary"))
        below = scratch.table(_contexts(told, path, n_buckets, _starts(sizes[k - 1]), sizes[k - 1], _starts(sizes[k - 2]) if k > 1 else None, k), f"contexts-{k}")
        stats = below.filter("block is null").collect()
        # A bucket that no run fell into told nothing, and has nothing.
        _fill(path, (followers_of(k), kinds_of(k), *((f"{counts_of(k)}-below",) if k > 1 else ())), {r["bucket"] for r in stats}, n_buckets)
        found.append(discounts([sum(r[f"n{i}"] for r in stats) for i in range(1, 5)]))
        scratch.drop(f"runs-{k + 1}")
        for name in (f"contexts-{k}", counts_of(k)) if k > 1 else ():
            remove(spark, f"{path}/{name}")  # the counts below the top have taken their place
    total = lambda name: sum(r[name] for r in stats)
    d, n_kinds = found[-1], total("kinds")
    rest = (d[1] * total("n1") + d[2] * total("n2") + d[3] * total("more")) / n_kinds if n_kinds else 1.0
    grams = tuple(Level(*level, ds) for level, ds in zip(levels, found[-2::-1], strict=True))
    return Model(path, n_buckets, starts, n_tokens, n_words, grams, d, n_kinds, rest)


def _sizes(stats: list, n_buckets: int) -> np.ndarray:
    sizes = np.zeros(n_buckets, dtype=np.int64)
    for r in stats:
        sizes[r["bucket"]] = r["n"]
    return sizes


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]])


_TOLD = "bucket long, block binary, n long, kinds long, n1 long, n2 long, n3 long, n4 long, more long"


def _told(bucket: int, n: int, kinds: int, counts: np.ndarray) -> pa.RecordBatch:
    """One row of numbers on a bucket: how many there are, the sum of their counts, and counts of counts."""
    numbers = (n, kinds, *(int((counts == i).sum()) for i in range(1, 5)), int((counts > 2).sum()))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.nulls(1, pa.binary()), *(pa.array([x], pa.int64()) for x in numbers)], names=[f.split()[0] for f in _TOLD.split(", ")])


def _passed(made: pa.RecordBatch) -> pa.RecordBatch:
    """Blocks for the buckets of shorter runs, in the same form."""
    none = pa.nulls(made.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([made.column(0), made.column(1), *[none] * 7], names=[f.split()[0] for f in _TOLD.split(", ")])


def _begun(n: np.ndarray) -> np.ndarray:
    """What runs with these counts tell of their contexts: tokens, and kinds seen once, twice, more; the fifth column is for kinds that end."""
    return np.column_stack([n, n == 1, n == 2, n > 2, np.zeros_like(n)]).astype(np.int64)


def _width(n: np.ndarray) -> str:
    return "<i8" if len(n) and n.max() > LARGEST else "<i4"


def _count_runs(rows: DataFrame, path: str, n_buckets: int, starts: np.ndarray, levels: tuple, shorter: np.ndarray, k: int, wide: bool, top: bool) -> DataFrame:
    """Counts the runs of ``k`` words into arrays; gives numbers per bucket, and blocks for the runs of one word less."""
    # Only pairs of narrow ids can be undone: else the ids of context and ending travel beside the count.
    beside = wide or k > 2

    def runs(batches):
        arrays = Arrays(path, n_buckets, starts)
        for tokens, ends in _gathered(batches):
            kinds, place = np.unique(np.append(tokens, np.uint64(START)), return_inverse=True)
            ids = arrays.word_ids(kinds)[place]
            for context, ending in _longer(arrays, levels, ids[:-1], ends, ids[-1]):
                pass
            there = context >= 0
            context, ending = context[there], ending[there]
            keys, at, n = np.unique(pair_keys(context, ids[:-1][there], wide), return_index=True, return_counts=True)
            yield blocks(keys, np.column_stack([n, context[at], ending[at]] if beside else [n]), bucket_of(keys, n_buckets))

    def keep(bucket, keys, sums):
        n = sums[:, 0]
        write_array(f"{path}/{keys_of(k)}/{bucket}", keys.astype("<u8"))
        write_array(f"{path}/{counts_of(k)}/{bucket}", n.astype(_width(n)))
        if beside:
            context, ending = sums[:, 1].astype(np.uint64), sums[:, 2].astype(np.uint64)
        else:
            both = _unmixed(keys)
            context, ending = both >> np.uint64(32), both & np.uint64(2**32 - 1)
        ended = np.zeros((len(n), 5), dtype=np.int64)
        ended[:, 4] = 1
        ids, told = ending, ended
        if top:
            ids, told = np.concatenate([context, ending]), np.concatenate([_begun(n), ended])
        else:
            write_array(f"{path}/contexts-{k}/{bucket}", context.astype("<u8"))
        ids, told = summed(ids, told)
        yield _passed(blocks(ids, told, np.searchsorted(shorter, ids.astype(np.int64), side="right") - 1))
        yield _told(bucket, len(n), 0, n)

    return merge(rows.mapInArrow(runs, "bucket long, block binary"), n_buckets, keep, _TOLD, 2 if beside else 0)


def _contexts(told: DataFrame, path: str, n_buckets: int, starts: np.ndarray, sizes: np.ndarray, shorter: np.ndarray | None, k: int) -> DataFrame:
    """Writes what follows runs of ``k`` words, and for pairs and longer ones the counts they have below the top; gives numbers and blocks as ``_count_runs`` does."""

    def keep(bucket, ids, sums):
        size = int(sizes[bucket])
        full = np.zeros((size, 5), dtype=np.int64)
        full[ids.astype(np.int64) - starts[bucket]] = sums
        # followers: tokens after the run, kinds that end in it. kinds: of longer runs it begins, by count 1, 2, 3 or more.
        write_array(f"{path}/{followers_of(k)}/{bucket}", full[:, [0, 4]].astype("<i8"))
        write_array(f"{path}/{kinds_of(k)}/{bucket}", full[:, 1:4].astype("<i8"))
        ends = full[:, 4]
        if k > 1:
            arrays = Arrays(path, n_buckets, starts)
            # Only what begins a text has no word before it.
            n = np.where(ends > 0, ends, arrays.get(counts_of(k), bucket))
            context = np.asarray(map_array(f"{path}/contexts-{k}/{bucket}", "<u8"))
            del arrays
            write_array(f"{path}/{counts_of(k)}-below/{bucket}", n.astype(_width(n)))
            context, begun = summed(context, _begun(n))
            yield _passed(blocks(context, begun, np.searchsorted(shorter, context.astype(np.int64), side="right") - 1))
            ends = n
        yield _told(bucket, size, int(ends.sum()), ends)

    return merge(told, n_buckets, keep, _TOLD)


class Scorer:
    """Log10 probabilities of texts, in one task."""

    def __init__(self, model: Model) -> None:
        self.model, self.arrays, self.hashes = model, Arrays(model.path, model.n_buckets, model.starts), WordHashes()

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """n_tokens, n_known, base score, score, each with one value per text."""
        m = self.model
        end = np.array([END], dtype=np.uint64)
        words = [self.hashes.of(lowered_words(t)) for t in texts]
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        tokens = np.concatenate([x for w in words for x in (w, end)]) if words else end[:0]
        if not len(tokens):
            return [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]
        kinds, place = np.unique(np.append(tokens, np.uint64(START)), return_inverse=True)
        ids = self.arrays.word_ids(kinds)
        known = ids >= 0
        counts, followers, parts = np.zeros(len(kinds)), np.zeros((len(kinds), 2)), np.zeros((len(kinds), 3))
        counts[known] = self.arrays.by_id("counts", ids[known])[:, 0]
        followers[known], parts[known] = self.arrays.by_id("followers", ids[known]), self.arrays.by_id("kinds", ids[known])

        d = np.array(m.word_discounts)
        ended = followers[:, 1]
        share = np.maximum(ended - d[np.minimum(ended, 3).astype(int)], 0) / max(m.n_kinds, 1) + m.word_rest / (m.n_words + 1)
        here, before = place[:-1], _before(place[:-1], ends, place[-1])
        chance, tokens_of = share[here], ids[here]
        after, parts = followers[before, 0], parts[before]
        context, begins = ids[before], np.concatenate([[0], ends[:-1]])
        for k, level in enumerate(m.grams, 2):
            d, pair = np.array(level.discounts), (context >= 0) & (tokens_of >= 0)
            seen, now = np.zeros(len(here)), np.full(len(here), -1, dtype=np.int64)
            if pair.any():
                keys, back = np.unique(pair_keys(context[pair], tokens_of[pair], level.wide), return_inverse=True)
                runs, n = self.arrays.runs(k, level.starts, keys, top=k == len(m.grams) + 1)
                now[pair], seen[pair] = runs[back], n[back]
            rest = np.where(after > 0, parts @ d[1:] / np.maximum(after, 1), 1.0)
            chance = np.maximum(seen - d[np.minimum(seen, 3).astype(int)], 0) / np.maximum(after, 1) + rest * chance
            if k <= len(m.grams):
                # The run that ends in a token is the context of the next; a text begins without.
                context = np.concatenate([[-1], now[:-1]])
                context[begins] = -1
                after, parts, there = np.zeros(len(here)), np.zeros((len(here), 3)), context >= 0
                runs, back = np.unique(context[there], return_inverse=True)
                after[there], parts[there] = self.arrays.by_id(followers_of(k), runs, level.starts)[back, 0], self.arrays.by_id(kinds_of(k), runs, level.starts)[back]
        chance = np.log10(chance)
        base = np.log10((counts[here] + 1) / (m.n_tokens + 1 * (m.n_words + 1)))
        begin = ends - sizes
        return [sizes, np.add.reduceat((counts[here] > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(chance, begin)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row."""

    def make():
        scorer = Scorer(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, known, base, found = scorer(as_bytes(batch.column(1)))
            train = np.full(len(n), model.n_tokens)
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, known, train, base, found, 10 ** (-found / np.maximum(n, 1))))], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        return each

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op6_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the training documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs.filter(~held_out(F.col("doc_id")))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
