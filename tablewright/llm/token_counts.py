"""Greedy word-piece counts by a linear longest-match automaton.

Greedy longest match cuts a word into vocabulary pieces from the left, each time taking the
longest piece that fits. The automaton does this in one pass over the bytes: a trie of the
vocabulary whose nodes have a failure link, the node that is reached after the pieces
matched so far are cut off, and the number of those pieces. Only the numbers are kept, so
no piece is built. Each byte moves one step down or follows failure links, which the steps
down have paid for: the work is linear in the text.

The vocabulary holds byte strings in which a piece that starts a word begins with a space;
every word is read as a space and its bytes. A word that cannot be cut counts as one unknown
piece.

Scale: a map without shuffle. The automaton is broadcast; its size is bounded by the
vocabulary file. Counts of short words are remembered per task in a table of bounded size.

Defined results: a null or empty text has no words and no pieces; other columns of the
table are ignored; repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.words import as_bytes, map_batches

#: A public byte-level vocabulary of 50,000 pieces, where this machine keeps it; everything here takes another path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROOT, NONE = 0, -1


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """The automaton of a vocabulary."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        self.step: dict[int, int] = {}
        final = [False]
        for piece in vocabulary:
            node = ROOT
            for byte in piece:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(final)
                    final.append(False)
                node = self.step[key]
            final[node] = bool(piece)
        self.fail, self.popped = self._links(final)

    def _links(self, final: list[bool]) -> tuple[list[int], list[int]]:
        fail, popped = [NONE] * len(final), [0] * len(final)
        # A child is made after its parent, but its link may need any shallower node.
        depth = [0] * len(final)
        for key, child in self.step.items():
            depth[child] = depth[key >> 8] + 1
        for key, child in sorted(self.step.items(), key=lambda x: depth[x[1]]):
            if final[child]:
                fail[child], popped[child] = ROOT, 1
                continue
            parent, byte = key >> 8, key & 255
            at, count = fail[parent], popped[parent]
            while at != NONE and (at << 8 | byte) not in self.step:
                count += popped[at]
                at = fail[at]
            if at != NONE:
                fail[child], popped[child] = self.step[at << 8 | byte], count
        return fail, popped

    def count(self, word: bytes) -> int:
        """The number of pieces of a word; 1 if it cannot be cut."""
        step, fail, popped = self.step, self.fail, self.popped
        node, pieces = ROOT, 0
        for byte in word:
            while (below := step.get(node << 8 | byte)) is None:
                if fail[node] == NONE:
                    return 1
                pieces += popped[node]
                node = fail[node]
            node = below
        while node != ROOT:
            if fail[node] == NONE:
                return 1
            pieces += popped[node]
            node = fail[node]
        return pieces


class _Counts(dict):
    """Counts of words, remembered; forgets all when full."""

    def __init__(self, automaton: LongestMatch, limit: int = 1 << 19) -> None:
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: Iterable[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for every row."""
    held = docs.sparkSession.sparkContext.broadcast(LongestMatch(vocabulary))

    def make():
        counts = _Counts(held.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [(t or b"").split() for t in as_bytes(batch.column(1))]
            tokens = [sum(map(counts.__getitem__, w)) for w in words]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

        return each

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy piece counts of every document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_vocabulary())
