"""Quality scores by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is
cut into pieces of ``piece`` bytes and each piece is compressed with either dictionary: the
dictionary that has seen such text makes it smaller. The difference of the two sizes,
normalised by the smaller size and by the length, is the evidence; with the compressed sizes per
byte themselves, which tell how much of a text merely repeats itself, a logistic regression
turns it into a calibrated score between 0 and 1. The differences alone rank as well; the sizes
set the cut where it belongs, as the README shows with figures.

Training takes at most ``per_class`` labelled documents of each class, those with the
smallest hash of their identifier, and of those no more than ``class_bytes`` bytes: a text
that does not fit into what is left is passed over, not those after it. A third
of them trains the calibration and is not in the dictionaries. The two classes may be cut by
different shares, so the labels of all documents are counted and the regression's intercept is
moved back to their odds. Documents in the held-out fold are never used. A score depends on
the text alone.

Scale: fitting counts the labels, shuffles only identifiers and the sampled documents and trains in one task
on them, whose size the settings bound; scoring is a map over whole texts without shuffle,
with about 200 KB of dictionaries broadcast.

Defined results: a null text counts as empty and is scored like any text; a null doc_id is
not held out and has no label; a label of null or without a document is ignored; a document
labelled more than once is good only if all its labels are; with no labels, or of one class
only, every score is that class's share (1 without labels); repeated rows give equal
scores; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.words import as_bytes, map_batches

FOLDS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    dictionary_bytes: int = 112 << 10
    piece: int = 1024
    level: int = 3
    per_class: int = 3000
    class_bytes: int = 12 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Dictionaries, and a logistic regression over standardised features; ``weights`` is None for a constant score."""

    settings: Settings
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    constant: float = 1.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Compressors made ready for one task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        if model.weights is not None:
            self.sizes = Sizes(model.settings, model.good, model.bad)

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        m = self.model
        if m.weights is None or not texts:
            return np.full(len(texts), m.constant)
        x = (self.sizes.features(texts) - m.mean) / m.scale
        z = x @ m.weights[:-1] + m.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Sizes:
    def __init__(self, settings: Settings, good: bytes, bad: bytes) -> None:
        def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
            held = {}
            if dictionary:
                held["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
                held["dict_data"].precompute_compress(level=settings.level)
            return zstandard.ZstdCompressor(level=settings.level, write_content_size=False, write_checksum=False, write_dict_id=False, **held)

        self.piece, self.good, self.bad, self.plain = settings.piece, compressor(good), compressor(bad), compressor(b"")

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        rows = []
        for text in texts:
            text = text or b""
            n = max(1, len(text))
            pieces = [text[i : i + self.piece] for i in range(0, len(text), self.piece)] or [b""]
            good = sum(len(self.good.compress(x)) for x in pieces)
            bad = sum(len(self.bad.compress(x)) for x in pieces)
            own = len(self.plain.compress(text))
            rows.append(((bad - good) / min(good, bad), (bad - good) / n, good / n, own / n))
        return np.array(rows, dtype=np.float64).reshape(len(rows), 4)


def _marks(labels: DataFrame) -> DataFrame:
    """id, good of each labelled identifier outside the held-out fold."""
    marks = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].alias("quality")).dropna()
    return marks.filter(~held_out(F.col("id"))).groupBy("id").agg((F.min("quality") == 1).alias("good"))


def sample_labelled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """At most ``per_class`` rows (good, h, id, text) of each class, in the order of their hashes, with ``class_bytes`` of text."""
    marks = _marks(labels)
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    # The smallest hashes are chosen among identifiers alone, before any text is moved; a null or missing text leaves its place empty.
    chosen = marks.filter("good").orderBy(F.xxhash64("id"), "id").limit(settings.per_class).union(marks.filter("not good").orderBy(F.xxhash64("id"), "id").limit(settings.per_class))
    # Rows that share an identifier are one document; which text of several stands for it must not vary.
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "good").agg(F.max("text").alias("text"))
    rows = rows.dropna().select("good", F.xxhash64("id").alias("h"), "id", "text")
    sizes = rows.select("good", "h", "id", F.octet_length("text").alias("size")).collect()
    fits = _fitting(sorted((r["good"], r["h"], r["id"], r["size"]) for r in sizes), settings.class_bytes)
    if len(fits) == len(sizes):
        return rows
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fits], "id long")), "id").select("good", "h", "id", "text")


def _fitting(sizes: list[tuple[bool, int, int, int]], class_bytes: int) -> list[int]:
    """The ids of those rows (good, h, id, size), taken in this order, that fit into the bytes their class has left; others are passed over."""
    left = {True: class_bytes, False: class_bytes}
    fits = []
    for good, _, i, size in sizes:
        if size <= left[good]:
            left[good] -= size
            fits.append(i)
    return fits


def class_counts(docs: DataFrame, labels: DataFrame) -> tuple[int, int]:
    """The good and bad labelled documents with a text outside the held-out fold, sampled or not."""
    texts = docs.filter(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("id"))
    found = {r["good"]: r["count"] for r in _marks(labels).join(texts, "id", "left_semi").groupBy("good").count().collect()}
    return found.get(True, 0), found.get(False, 0)


def _dictionary(texts: list[bytes], settings: Settings) -> bytes:
    """A trained dictionary; of too little text, the text itself."""
    pieces = [t[i : i + settings.piece] for t in texts for i in range(0, len(t), settings.piece)]
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[: settings.dictionary_bytes]


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Newton's method for a logistic regression with an intercept as the last weight."""
    x = np.column_stack([x, np.ones(len(x))])
    weights, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(x))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, x.T @ (p - y) + penalty * weights)
        weights -= move
        if np.abs(move).max() < 1e-9:
            break
    return weights


def trained(rows: list[tuple[bool, int, int, str]], settings: Settings, counts: tuple[int, int] | None = None) -> Model:
    """A model of sampled rows (good, h, id, text), whatever their order; ``counts`` are the good and bad of all rows (these without)."""
    rows = sorted(rows, key=lambda r: r[1:3])
    good, bad = ([r[3].encode() for r in rows if r[0] is mark] for mark in (True, False))
    nothing = np.zeros(4)
    if len(good) < 3 or len(bad) < 3:
        n_good, n_bad = counts or (len(good), len(bad))
        share = n_good / (n_good + n_bad) if n_good + n_bad else 1.0
        return Model(settings, b"", b"", nothing, nothing + 1, None, share)
    learn, test = (lambda t: [x for i, x in enumerate(t) if i % 3]), (lambda t: t[::3])
    good_dictionary, bad_dictionary = _dictionary(learn(good), settings), _dictionary(learn(bad), settings)
    x = Sizes(settings, good_dictionary, bad_dictionary).features(test(good) + test(bad))
    y = np.array([1.0] * len(test(good)) + [0.0] * len(test(bad)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _regression((x - mean) / scale, y)
    n_good, n_bad = counts or (len(good), len(bad))
    weights[-1] += np.log(n_good / n_bad) - np.log(len(test(good)) / len(test(bad)))
    return Model(settings, good_dictionary, bad_dictionary, mean, scale, weights)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Trains in one task on the bounded sample; the driver sees counts, the sizes of the sampled texts and the model."""
    settings = settings or Settings()
    counts = class_counts(docs, labels)

    def run(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained(rows, settings, counts))], pa.binary())], names=["model"])

    made = sample_labelled(docs, labels, settings).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else trained([], settings, counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = held.value.scorer()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(as_bytes(batch.column(1))))], names=["doc_id", "score"])

        return each

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from tablewright.llm.words import slices

        scorer = held.value.scorer()
        for batch in slices(batches):
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array(scorer(as_bytes(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
