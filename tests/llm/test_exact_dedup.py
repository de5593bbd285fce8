import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup
from tablewright.llm.exact_dedup import ExactDedup, ingest_log, read_state, run_stream
from tablewright.storage import Scratch

DOCS = "doc_id long, text string, digest string, keep_id long, n string"
ROWS = [(1, "a", "x", 0, "p"), (5, "a", "y", 0, "q"), (3, "b", None, 0, ""), (4, None, "", 0, ""), (9, "", "", 0, ""), (7, "c" * 300_000, "", 0, ""), (8, "c" * 300_000, "", 0, ""), (None, "a", "", 0, ""), (None, "lone", "", 0, ""), (5, "a", "again", 0, "")]


def weak(text):
    """A digest that clashes: the length of the text."""
    return F.length(text).cast("string")


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


def check(found, rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    assert len(found) == len(rows)
    for text, members in groups.items():
        keep = max((m for m in members if m is not None), default=None)
        mine = [r for r in found if r["digest_of"] == hashlib.sha256(text.encode()).hexdigest()]
        assert sorted(str(r["doc_id"]) for r in mine) == sorted(map(str, members))
        assert {r["keep_id"] for r in mine} == {keep}
        assert {r["group_size"] for r in mine} == {len(members)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [keep]


def test_verdicts(docs):
    check([r.asDict() | {"digest_of": r["digest"]} for r in ExactDedup(docs).verdicts().collect()], ROWS)


def test_survivors_are_whole_rows(docs):
    found = ExactDedup(docs).survivors()
    assert found.schema == docs.schema
    rows = found.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["5", "3", "9", "8", "None"])
    assert all(tuple(r) in ROWS for r in rows)


def test_bytes_decide_where_digests_clash(spark):
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz"), (5, "ab"), (6, "xyw")]
    found = ExactDedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=weak)
    assert found.clashes is not None
    verdicts = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in found.verdicts().collect()}
    assert verdicts == {1: (5, 3, False), 2: (2, 1, True), 3: (5, 3, False), 4: (4, 1, True), 5: (5, 3, True), 6: (6, 1, True)}
    assert sorted(r["doc_id"] for r in found.survivors().collect()) == [2, 4, 5, 6]


def test_state_lives_on_between_runs(spark):
    scratch = Scratch(spark, "state-test")
    for part in ([(1, "a"), (2, "b")], [(3, "a"), (4, "c")]):
        ingest_log(spark.createDataFrame(part, "doc_id long, text string")).write.mode("append").parquet(scratch.at("log"))
        run_stream(spark.readStream.schema(spark.read.parquet(scratch.at("log")).schema).parquet(scratch.at("log")), scratch.at("state"))
    names = {p.suffix for p in Path(scratch.at("state").removeprefix("file://")).rglob("*") if "state" in p.parts}
    assert names & {".changelog", ".zip"}  # RocksDB on disk, not a map in memory
    assert ".delta" not in names
    state = {r["digest"]: (r["keep_id"], r["n"]) for r in read_state(spark, scratch.at("state")).collect()}
    of = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert state == {of("a"): (3, 2), of("b"): (2, 1), of("c"): (4, 1)}


def test_empty(spark):
    found = ExactDedup(spark.createDataFrame([], DOCS))
    assert found.verdicts().count() == found.survivors().count() == 0


def test_rows_without_identifier_are_compared_once(spark, tmp_path):
    """One kept text per group: the byte check grows with the rows, not with their square."""
    rows = [(None, "same text")] * 2000 + [(i, f"own {i}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    found = ExactDedup(spark.read.parquet(str(tmp_path / "docs")))
    compared = found._with_groups(found.log, found.hits.select("digest", "n_bytes", "keep_row"), "inner")
    assert compared.count() == 2000
    assert compared.select("digest", F.spark_partition_id()).distinct().count() >= 1
    assert found.heavy.first()["tasks"] > 900
    verdicts = found.verdicts().collect()
    assert sum(r["kept"] for r in verdicts) == 51
    assert {(r["keep_id"], r["group_size"]) for r in verdicts if r["doc_id"] is None} == {(None, 2000)}
    assert found.survivors().count() == 51


def test_locators_find_the_texts_again(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = ExactDedup(docs)
    assert found.docs is docs
    again = docs.select("doc_id", *exact_dedup.locator(docs)).join(found.hits, [F.col("file") == F.col("keep_file"), F.col("row_no") == F.col("keep_row")])
    assert sorted((r["doc_id"], r["keep_id"]) for r in again.collect()) == [(i, i) for i in range(33, 40)]
