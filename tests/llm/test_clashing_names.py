"""Tables whose other columns have the names that the operators use inside."""

import pytest
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, mixing, quality
from tablewright.llm.exact_dedup import ExactDedup
from tablewright.llm.line_dedup import LineDedup
from tablewright.llm.near_dedup import NearDedup
from tablewright.llm.passage_dedup import PassageDedup

NAMES = "_metadata file row_no task tasks digest n_bytes keep key rank node id part of row_key __gone __gone_key component gone removed size total copies taken bucket body row text_a".split()
PASSAGE = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, f"{PASSAGE} one", "s"), (2, f"{PASSAGE} one", "s"), (3, f"{PASSAGE} two", None), (4, "other words", "t"), (None, None, "t"), (None, "other words", "t")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("clash") / "docs")
    made = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    made.select("*", *[F.concat(F.lit("x"), F.coalesce("doc_id", F.lit(0))).alias(n) for n in NAMES]).repartition(2).write.parquet(where)
    return spark.read.parquet(where)


def whole(found):
    """The identifiers, if every row has the other columns as they were."""
    rows = found.collect()
    assert all(r[n] == f"x{r['doc_id'] or 0}" for r in rows for n in NAMES)
    return sorted(str(r["doc_id"]) for r in rows)


def test_stages_keep_whole_rows(spark, docs):
    assert whole(ExactDedup(docs).survivors()) == ["2", "3", "4", "None"]
    assert whole(ExactDedup(docs.filter("true")).survivors()) == ["2", "3", "4", "None"]
    assert whole(NearDedup(docs).survivors()) == ["1", "4", "None"]
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert whole(decontaminate.keep_clean(docs, items)) == ["4", "None", "None"]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert len(whole(quality.keep_good(docs, quality.fit(docs, labels)))) == 6
    assert set(whole(mixing.apply_mix(docs))) == {"1", "2", "3", "4", "None"}


def test_verdicts_are_of_the_texts(docs):
    assert sorted(str(r["keep_id"]) for r in ExactDedup(docs).verdicts().collect()) == ["2", "2", "3", "4", "4", "None"]
    assert sorted(str(r["component_id"]) for r in NearDedup(docs).groups().collect()) == ["1", "1", "1", "4", "4", "None"]
    assert sum(len(r["removed"]) for r in PassageDedup(docs).result().collect()) == 2
    assert sum(len(r["removed"]) for r in LineDedup(docs, min_words=1).result().collect()) == 2
