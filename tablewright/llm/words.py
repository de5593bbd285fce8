"""Words and hashes of words, shared by the operators that read texts in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Documents a Python worker holds at once: texts of 100 KB then make a batch of some 25 MB.
BATCH_ROWS = 256
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all when full, so memory stays bounded."""

    def __init__(self, limit: int = 1 << 19) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def lowered_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space: space and 0x09 to 0x0D."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of ``n`` words, in order; none if there are fewer."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(k, n, dtype=np.uint64)
    for i in range(n):
        total = mixed(total + hashes[i : i + k] * np.uint64(_MULTIPLIERS[i % 8])) if i % 2 else total + hashes[i : i + k] * np.uint64(_MULTIPLIERS[i % 8])
    return mixed(total)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingle hashes, sorted; a text of fewer words is one shingle, an empty one none."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    return np.unique(ngram_hashes(hashes, min(n, len(hashes))))


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Smaller batches: what is made from one batch is handed on before the next is begun."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return column.cast(pa.large_binary()).to_pylist() if pa.types.is_large_string(column.type) else column.cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies to each small batch what ``make`` returns; ``make`` runs once in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in slices(batches):
            yield each(batch)

    return df.mapInArrow(run, schema)
