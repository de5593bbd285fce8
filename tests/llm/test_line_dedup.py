import duckdb
import pytest

from tablewright.llm import registry
from tablewright.llm.line_dedup import LineDedup, cleaned

from ..conftest import TESTDATA
from ..test_entry import same

SMALL = TESTDATA / "sf0.001"

LONG = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(12))


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "k", 1, "d") for r in rows], "doc_id long, text string, key string, first int, digest string").repartition(3)
    return [(r["doc_id"], [tuple(s) for s in r["removed"]], r["clean_text"]) for r in LineDedup(docs, **options).result().collect()]


def by_id(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0], str(r)))


def test_the_earliest_stays(spark):
    rows = [(3, f"a\n{LONG}\nb"), (1, f"{LONG.upper()}\nx"), (2, f"y\n  {LONG.replace(' ', '  ')}\t"), (4, f"short\n{OTHER}\n{OTHER}\nshort")]
    spaced = len(f"  {LONG.replace(' ', '  ')}\t")
    assert by_id(run(spark, rows)) == [
        (1, [], rows[1][1]),
        (2, [(2, 2 + spaced, 1)], "y"),
        (3, [(2, 2 + len(LONG), 1)], "a\nb"),
        (4, [(6 + len(OTHER) + 1, 6 + 2 * len(OTHER) + 1, 4)], f"short\n{OTHER}\nshort"),
    ]


def test_offsets_are_code_points(spark):
    text = f"\U0001f600é\n{LONG}\nend"
    found = by_id(run(spark, [(1, LONG), (2, text)]))
    (start, end, kept_in), = found[1][1]
    assert (text[start:end], kept_in, found[1][2]) == (LONG, 1, "\U0001f600é\nend")


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, f"{LONG}\nz"), (None, f"{OTHER}\nn"), (None, f"{OTHER}\nm"), (5, "q " * 100_000 + f"\n{LONG}")]
    found = by_id(run(spark, rows))
    assert found[:4] == [(1, [], None), (2, [], ""), (3, [], LONG), (3, [], LONG)]
    assert found[4][1] == [(200_001, 200_001 + len(LONG), 3)]
    # Rows without a doc_id rank last, and equal among themselves.
    assert sorted(r[2] for r in found[5:]) == sorted(["z", f"{OTHER}\nn", f"{OTHER}\nm"])
    assert run(spark, rows[:0]) == []


def test_paragraphs(spark):
    rows = [(1, f"{OTHER}\n{LONG}"), (2, f"a\n\n{OTHER}\n{LONG}\n\nb")]
    assert by_id(run(spark, rows, unit="paragraph"))[1][2] == "a\n\nb"
    assert cleaned("a\n\nb", [(0, 1)], "\n\n") == "b"


def test_one_line_in_very_many_documents(spark):
    found = run(spark, [(i, f"{LONG}\nown {i}") for i in range(500)])
    assert sum(len(r[1]) for r in found) == 499
    assert {r[2] for r in found if r[0]} == {f"own {i}" for i in range(1, 500)}


def test_short_lines_are_units_of_every_line_dedup(spark, tmp_path):
    rows = [(i, f"Yes.\n\nown {i}\n\nYES.") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["clean_text"] for r in registry.further_queries()["every_line_dedup"](spark, str(tmp_path)).collect()}
    assert found == {i: f"{'Yes.' + chr(10) if not i else ''}\nown {i}\n" for i in range(300)}


@pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.further_sql()))
def test_whole_lines_equal_their_sql(spark, name):
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
        same(registry.further_queries()[name](spark, str(SMALL)).toPandas(), connection.execute(registry.further_sql()[name]).df())
