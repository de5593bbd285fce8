import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import quality
from tablewright.llm.quality import Settings, fit, held_out, keep_good, score


def make(n, seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choices("aeioulnrst", k=draw.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        good = draw.random() < 0.7
        text = " ".join(draw.choices(words, k=draw.randint(20, 120)))
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "x", 0.5))
        labels.append((i, int(good), 0))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, label string, score double", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = make(400)
    frame, marks = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)
    model = fit(frame, marks)
    truth = dict((d, q) for d, q, _ in labels)
    found = {r["doc_id"]: r["score"] for r in score(frame, model).collect()}
    test = [d for d in found if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(found) == 400
    assert np.mean([(found[d] >= quality.THRESHOLD) == truth[d] for d in test]) > 0.97
    assert all(0 <= s <= 1 for s in found.values())
    kept = keep_good(frame, model)
    assert kept.schema == frame.schema
    assert {r["doc_id"] for r in kept.collect()} == {d for d, s in found.items() if s >= quality.THRESHOLD}


def test_held_out_labels_teach_nothing(spark):
    docs, labels = make(150)
    frame = spark.createDataFrame(docs, DOCS)
    changed = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    a, b = (fit(frame, spark.createDataFrame(x, LABELS)) for x in (labels, changed))
    assert (a.good, a.bad) == (b.good, b.bad)
    assert (a.weights == b.weights).all()


def test_scores_do_not_depend_on_order_or_partitions(spark):
    docs, labels = make(120)
    marks = spark.createDataFrame(labels, LABELS)
    found = []
    for parts in (1, 5):
        frame = spark.createDataFrame(docs, DOCS).repartition(parts)
        found.append({r["doc_id"]: r["score"] for r in score(frame, fit(frame, marks)).collect()})
    assert found[0] == found[1]


def test_odd_texts_and_labels(spark):
    docs, labels = make(120)
    docs += [(900, None, "", 0.0), (901, "", "", 0.0), (902, "word " * 60_000, "", 0.0), (None, "a", "", 0.0), (900, None, "", 0.0)]
    labels += [(900, 1, 0), (None, 0, 0), (5000, 0, 0), (1, None, 0), (2, 0, 0), (2, 1, 0)]
    frame = spark.createDataFrame(docs, DOCS)
    found = score(frame, fit(frame, spark.createDataFrame(labels, LABELS))).collect()
    assert len(found) == len(docs)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (900, 901)}) == 1
    assert score(frame.limit(0), fit(frame, spark.createDataFrame(labels, LABELS))).count() == 0


@pytest.mark.parametrize(("labels", "expected"), [([], 1.0), ([(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0)], 1.0), ([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0)], 0.0)])
def test_one_class_is_its_share(spark, labels, expected):
    docs = [(i, "some text", "", 0.0) for i in range(1, 8)]
    frame = spark.createDataFrame(docs, DOCS)
    found = {r["score"] for r in score(frame, fit(frame, spark.createDataFrame(labels, LABELS))).collect()}
    assert found == {expected}


def test_sample_is_bounded(spark):
    docs, labels = make(300)
    small = Settings(per_class=20, class_bytes=4000)
    rows = quality.sample_labelled(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), small).collect()
    for good in (True, False):
        mine = [r for r in rows if r["good"] is good]
        assert 0 < len(mine) <= 20
        assert sum(len(r["text"].encode()) for r in mine) <= 4000


def test_folds(spark):
    rows = spark.range(60).withColumn("h", held_out(F.col("id"))).collect()
    assert [r["h"] for r in rows] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60)]


def test_the_cap_does_not_move_the_prior(spark):
    """A small sample, of as many good as bad, gives the odds of all labels: the cut at 0.3 stays where a large one has it."""
    draw = random.Random(3)
    words = ["".join(draw.choices("aeioulnrst", k=draw.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(2000):
        good = draw.random() < 0.85
        # The classes overlap: a text is a mixture of plain and loud words.
        loud = draw.gauss(0.35 if good else 0.65, 0.15)
        docs.append((i, " ".join(w.upper() + "!!" if draw.random() < loud else w for w in draw.choices(words, k=40)), "x", 0.5))
        labels.append((i, int(good), 0))
    frame, marks = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)
    test = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 0]
    found = []
    for per_class in (200, 3000):
        scores = {r["doc_id"]: r["score"] for r in score(frame, fit(frame, marks, Settings(per_class=per_class))).collect()}
        found.append(np.array([scores[i] for i in test]))
    small, large = found
    share = np.mean([labels[i][1] for i in test])
    assert abs(small.mean() - share) < 0.05 and abs(large.mean() - share) < 0.05
    assert np.mean((small >= quality.THRESHOLD) == (large >= quality.THRESHOLD)) > 0.93


def test_a_text_that_does_not_fit_ends_nothing(spark):
    docs, labels = make(200)
    settings = Settings(per_class=500, class_bytes=200_000)
    marks = spark.createDataFrame(labels, LABELS)
    order = spark.createDataFrame(labels, LABELS).filter("quality = 1").filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    longer = [(d, t + " long" * 50_000 if d == order else t, *rest) for d, t, *rest in docs]
    ids = [{r["id"] for r in quality.sample_labelled(spark.createDataFrame(x, DOCS), marks, settings).collect()} for x in (docs, longer)]
    assert order in ids[0]
    assert ids[1] == ids[0] - {order}
    assert fit(spark.createDataFrame(longer, DOCS), marks, settings).weights is not None


def by_definition(model, text):
    """A score from sizes by fresh compressors, one piece at a time, and the logistic function written out."""
    import math

    import zstandard

    text = (text or "").encode()
    plain = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    pieces = [text[i : i + 1024] for i in range(0, max(1, len(text)), 1024)]
    size = lambda dictionary: sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), **plain).compress(x)) for x in pieces)
    a, b, n, own = size(model.good), size(model.bad), max(1, len(text)), len(zstandard.ZstdCompressor(**plain).compress(text))
    z = model.weights[-1]
    for f, w, m, s in zip(((b - a) / min(a, b), (b - a) / n, a / n, own / n), model.weights, model.mean, model.scale, strict=False):
        z += w * (f - m) / s
    return 1 / (1 + math.exp(-max(-500, min(500, z))))


def test_scores_equal_their_definition(spark):
    draw = random.Random(3)
    good = [" ".join(draw.choices("river stone meadow cloud harvest lantern winter".split(), k=draw.randint(20, 400))) for _ in range(40)]
    bad = [" ".join(draw.choices("WIN!!! free$$$ click>> 777 <<now".split(), k=draw.randint(20, 400))) for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad, "", None, "x" * 5000, "é" * 700])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == pytest.approx(by_definition(model, r["text"]), abs=1e-9)
