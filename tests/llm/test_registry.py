import duckdb
import pytest

import __spark_entry__ as entry
from tablewright.llm import registry

from ..conftest import TESTDATA
from ..test_entry import TABLES, same

SMALL = TESTDATA / "sf0.001"


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.queries())
    assert numbers == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert {*registry.queries(), "pipeline"} <= set(entry.queries())


@pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as connection:
        for table in TABLES:
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
        same(registry.queries()[name](spark, str(SMALL)).toPandas(), connection.execute(registry.oracle_sql()[name]).df())


@pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_judge_every_document(spark, name):
    assert registry.queries()[name](spark, str(SMALL)).select("doc_id").distinct().count() == 200


def test_the_rest_needs_none_of_this(monkeypatch):
    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert not [name for name in entry.queries() if name.startswith("op") or name == "pipeline"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
