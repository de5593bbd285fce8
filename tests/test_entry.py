import duckdb
import pytest

import __spark_entry__ as entry
from tablewright.plans import catalog

from .conftest import TESTDATA

SMALL = TESTDATA / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views():
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
        yield connection


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = [sorted(map(tuple, x[columns].astype(str).to_numpy())) for x in (a, b)]
    assert rows[0] == rows[1]


@pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, views, name):
    same(catalog.queries()[name](spark, str(SMALL)).toPandas(), views.execute(catalog.oracle_sql()[name]).df())


def test_every_query_is_registered():
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
