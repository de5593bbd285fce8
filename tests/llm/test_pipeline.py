import random
import re

import pytest

import corpus_pipeline
from tablewright.llm import quality
from tablewright.llm.mixing import MixPlan

from .test_decontaminate import brute_tiles
from .test_mixing import targets
from .test_near_dedup import brute as brute_groups
from .test_quality import by_definition

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(11)
    vocabulary = ["".join(draw.choices("aeioulnrst", k=draw.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(i, prose(25)) for i in range(6)]
    texts, marks = [], []
    for _ in range(160):
        good = draw.random() < 0.75
        text = prose(draw.randint(30, 90))
        texts.append(text if good else " ".join(w.upper() + "!!" for w in text.split()))
        marks.append(int(good))
    for i in range(0, 20, 2):
        words = texts[i].split()
        words[len(words) // 2] = "edited"
        texts += [texts[i], " ".join(words)]
        marks += [marks[i]] * 2
    for _, item in items:
        words = item.split()
        texts.append(f"{prose(30)} {' '.join(words[12:])} {prose(10)} {' '.join(words[:12])} {prose(20)}")
        marks.append(1)
    texts += [None, "", "single"]
    marks += [1, 0, 1]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return rows, [(i, m, 0) for i, m in enumerate(marks) if i % 5 != 3], items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where, (docs, labels, items) = tmp_path_factory.mktemp("corpus"), corpus()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages_equal_brute_force(spark, folder):
    rows, _, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [r for r in rows if by_definition(model, r[1]) >= 0.3]
    largest = {}
    for r in kept:
        largest[r[1] or ""] = max(largest.get(r[1] or "", -1), r[0])
    kept = [r for r in kept if largest[r[1] or ""] == r[0]]
    group = brute_groups([(r[0], r[1]) for r in kept], 5)
    kept = [r for r in kept if group[r[0]][1] == r[0]]
    words = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()).split()
    kept = [r for r in kept if not any(brute_tiles(words(t), words(r[1]), 5) >= 0.8 * len(words(t)) for _, t in items)]
    sizes = {}
    for r in kept:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())

    found = corpus_pipeline.run(spark, folder).collect()
    words = {}
    for r in found:
        assert tuple(r)[:5] in {tuple(x) for x in kept}
        words[r["source"]] = words.get(r["source"], 0) + r["mix_words"]
    for source, wanted in targets(sizes, MixPlan()).items():
        assert words.get(source, 0) == pytest.approx(wanted, abs=0.51)
    # Every source with room for whole epochs holds each of its documents.
    full = {s for s, t in targets(sizes, MixPlan()).items() if t >= sizes[s]}
    assert {r["doc_id"] for r in found if r["source"] in full} == {r[0] for r in kept if r[3] in full and (r[1] or "").split()}


def test_each_stage_returns_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.selectExpr("*", "'x' AS digest", "1 AS row", "2 AS taken", "3 AS mix_key")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs, folder).columns[:5] == docs.columns
        assert (stage(spark, docs, folder).columns == docs.columns) == (n < len(corpus_pipeline.STAGES) - 1)
        found = stage(spark, wide, folder)
        assert found.columns[: len(wide.columns)] == wide.columns
        assert {(r["digest"], r["row"], r["taken"], r["mix_key"]) for r in found.collect()} == {("x", 1, 2, 3)}


def test_stages_of_nothing(spark, folder):
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
