"""The registered queries over the driver's tables and their SQL equivalents.

Tables come from Parquet; row ids are ranks of a unique key, found without a global window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import duplicates, ordering, overlay, paging, search
from tablewright.plans import behaviour
from tablewright.sources import sink
from tablewright.sources.delimited import Source, from_table, with_size_policy
from tablewright.sources.settings import ParseSettings
from tablewright.storage import Scratch, hadoop_path

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return _QUERIES | behaviour.queries()


def oracle_sql() -> dict[str, str]:
    return _ORACLES | behaviour.oracle_sql()


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str, name: str, key: str, columns: Sequence[str] = (), fill: bool = True) -> DataFrame:
    """row_id and the text of some columns (all without a list)."""
    df = _read(spark, sf_dir, name)
    columns = list(columns) or df.columns
    return from_table(df.select(key, *[c for c in columns if c != key]), key, fill).select("row_id", *columns)


def _ids_sql(name: str, key: str, where: str) -> str:
    return f"SELECT row_id FROM (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS row_id FROM {name}) WHERE {where}"


# ---- search


@_query(_ids_sql("part", "p_partkey", "contains(lower(p_name), 'blue')"))
def search_contains_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_cells(spark, sf_dir, "part", "p_partkey", ["p_name"], fill=False), "BLUE", 0)


@_query(_ids_sql("part", "p_partkey", "contains(p_type, 'ECONO')"))
def search_contains_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_cells(spark, sf_dir, "part", "p_partkey", ["p_type"], fill=False), "ECONO", 0, match_case=True)


@_query(_ids_sql("events", "event_id", "lower(event_type) = 'click'"))
def search_cell_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_cells(spark, sf_dir, "events", "event_id", ["event_type"], fill=False), "CLICK", 0, whole_cell=True)


@_query(_ids_sql("customer", "c_custkey", "c_mktsegment = 'BUILDING'"))
def search_cell_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_cells(spark, sf_dir, "customer", "c_custkey", ["c_mktsegment"], fill=False), "BUILDING", 0, whole_cell=True, match_case=True)


_PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@_query(_ids_sql("part", "p_partkey", " OR ".join(f"contains(lower({c}::VARCHAR), '1')" for c in _PART_COLUMNS)))
def search_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_cells(spark, sf_dir, "part", "p_partkey", _PART_COLUMNS, fill=False), "1")


@_query(_ids_sql("documents", "doc_id", "contains(lower(text), 'the')"))
def search_text_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_cells(spark, sf_dir, "documents", "doc_id", ["text"], fill=False), "The", 0)


@_query(_ids_sql("nation", "n_nationkey", "false"))
def search_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_cells(spark, sf_dir, "nation", "n_nationkey"), "a", 99)


@_query(_ids_sql("supplier", "s_suppkey", "contains(s_name, '')"))
def search_empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty query is in every cell that is there."""
    return search.search(_cells(spark, sf_dir, "supplier", "s_suppkey", ["s_name"]), "", 0)


@_query(_ids_sql("events", "event_id", "lower(event_type) = 'purchase'"))
def search_index_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.SearchIndex(_cells(spark, sf_dir, "events", "event_id", ["event_type"])).search("Purchase", 0, whole_cell=True)


@_query(_ids_sql("part", "p_partkey", "contains(lower(p_name), 'giz')"))
def search_index_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.SearchIndex(_cells(spark, sf_dir, "part", "p_partkey", ["p_name"])).search("GIZ", 0)


@_query("SELECT lower(event_type) AS key, count(*) AS n, min(row_id) AS first_id, max(row_id) AS last_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events) GROUP BY 1")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.inverted_index(_cells(spark, sf_dir, "events", "event_id", ["event_type"]), 0)


@_query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, contains(lower(c_name), '1') AS hit_c_name, contains(lower(c_mktsegment), '1') AS hit_c_mktsegment FROM customer")
def highlight_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.highlights(_cells(spark, sf_dir, "customer", "c_custkey", ["c_name", "c_mktsegment"]), " 1 ")


# ---- paging

_ORDER_COLUMNS = ("o_orderkey", "o_orderstatus", "o_orderpriority")


@_query(f"SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, {', '.join(f'{c}::VARCHAR AS {c}' for c in _ORDER_COLUMNS)} FROM orders) WHERE row_id BETWEEN 800 AND 1599")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(_cells(spark, sf_dir, "orders", "o_orderkey", _ORDER_COLUMNS), paging.PAGE_ROWS, paging.PAGE_ROWS)


_ASKED = (42, 7, 7, 1_000_000_000, 0, 149)


@_query(f"SELECT position, a.row_id, c_name FROM (VALUES {', '.join(f'({i}::BIGINT, {r}::BIGINT)' for i, r in enumerate(_ASKED))}) a(position, row_id) LEFT JOIN (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_name FROM customer) t USING (row_id)")
def rows_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.rows_by_id(_cells(spark, sf_dir, "customer", "c_custkey", ["c_name"]), _ASKED)


@_query("SELECT count(*) AS n FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


# ---- order


def _order_sql(name: str, key: str, column: str, direction: str) -> str:
    return f"SELECT row_id, row_number() OVER (ORDER BY {column}::VARCHAR {direction}, row_id) - 1 AS display_idx FROM (SELECT {column}, row_number() OVER (ORDER BY {key}) - 1 AS row_id FROM {name})"


@_query(_order_sql("orders", "o_orderkey", "o_orderdate", "ASC"))
def sort_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sort_order(_cells(spark, sf_dir, "orders", "o_orderkey", ["o_orderdate"]), "o_orderdate")


@_query(_order_sql("orders", "o_orderkey", "o_orderdate", "DESC"))
def sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sort_order(_cells(spark, sf_dir, "orders", "o_orderkey", ["o_orderdate"]), "o_orderdate", ascending=False)


_SORTED_PART = "SELECT row_number() OVER (ORDER BY p_name, row_id) - 1 AS display_idx, row_id, p_name FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part)"


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "part", "p_partkey", ["p_name"])


@_query(f"SELECT * FROM ({_SORTED_PART}) WHERE display_idx BETWEEN 100 AND 149")
def sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sorted_page(_part_names(spark, sf_dir), "p_name", 100, 50)


@_query(f"SELECT * FROM ({_SORTED_PART}) WHERE display_idx BETWEEN 100 AND 149")
def sorted_page_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a written order, as for deep pages."""
    table = _part_names(spark, sf_dir)
    return ordering.sorted_page(table, "p_name", 100, 50, order=ordering.sort_order(table, "p_name"))


@_query(f"SELECT display_idx, row_id FROM ({_SORTED_PART}) WHERE display_idx BETWEEN 10 AND 39")
def sorted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sorted_ids(ordering.sort_order(_part_names(spark, sf_dir), "p_name"), 10, 30)


@_query("SELECT row_id, display_idx FROM (" + _order_sql("supplier", "s_suppkey", "s_name", "DESC") + ") WHERE row_id % 3 = 0")
def inverse_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _cells(spark, sf_dir, "supplier", "s_suppkey", ["s_name"])
    return ordering.display_places(ordering.sort_order(table, "s_name", ascending=False), table.filter("row_id % 3 = 0"))


@_query("SELECT row_id, display_idx FROM (" + _order_sql("supplier", "s_suppkey", "s_name", "DESC") + ")")
def inverse_order_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all rows."""
    table = _cells(spark, sf_dir, "supplier", "s_suppkey", ["s_name"])
    return ordering.display_places(ordering.sort_order(table, "s_name", ascending=False), table)


@_query(f"SELECT row_id, display_idx FROM ({_SORTED_PART}) WHERE contains(lower(p_name), 'blue')")
def match_in_sorted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _part_names(spark, sf_dir)
    return ordering.display_places(ordering.sort_order(table, "p_name"), search.search(table, "blue", 0))


# ---- duplicates


@_query("SELECT row_id FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, count(*) OVER (PARTITION BY p_name, p_brand, p_type) AS n FROM part) WHERE n > 1")
def dups_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicates(_cells(spark, sf_dir, "part", "p_partkey", ["p_name", "p_brand", "p_type"]))


@_query("SELECT row_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def dups_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicates(_cells(spark, sf_dir, "documents", "doc_id", ["text", "lang"]), ["text"])


# ---- overlay

_SELECTED = ((5, 7), (1, 2), (3, 4), (100, 250))


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "orders", "o_orderkey", _ORDER_COLUMNS)


_ORDER_ROWS = f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, {', '.join(f'{c}::VARCHAR AS {c}' for c in _ORDER_COLUMNS)} FROM orders"


@_query(f"SELECT * FROM ({_ORDER_ROWS}) WHERE row_id % 10 <> 3")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _order_rows(spark, sf_dir)
    return overlay.without_deleted(table, table.filter("row_id % 10 = 3").select("row_id"))


@_query(f"SELECT * FROM ({_ORDER_ROWS}) WHERE row_id NOT IN (1, 3)")
def restore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = overlay.Overlay()
    pending.delete([1, 2, 3])
    pending.restore([2])
    return pending.apply(_order_rows(spark, sf_dir))


@_query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_name, CASE WHEN (row_number() OVER (ORDER BY c_custkey) - 1) % 7 = 0 THEN 'EDITED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _cells(spark, sf_dir, "customer", "c_custkey", ["c_name", "c_mktsegment"])
    edits = table.filter("row_id % 7 = 0").select("row_id", F.lit(1).alias("col_idx"), F.lit("EDITED").alias("value"))
    return overlay.apply_edits(table, edits)


@_query(f"SELECT row_id FROM ({_ORDER_ROWS}) WHERE row_id BETWEEN 1 AND 7 OR row_id BETWEEN 100 AND 250")
def range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_rows(spark, sf_dir).filter(overlay.in_ranges(F.col("row_id"), _SELECTED)).select("row_id")


# ---- sinks and sources


def _cell_sql(column: str) -> str:
    return f"""CASE WHEN contains({column}, ',') OR contains({column}, '"') OR contains({column}, chr(10)) OR contains({column}, chr(13)) THEN '"' || replace({column}, '"', '""') || '"' ELSE {column} END"""


@_query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, concat_ws(',', {_cell_sql('doc_id::VARCHAR')}, {_cell_sql('text')}, {_cell_sql('lang')}) AS line FROM documents")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.lines(_cells(spark, sf_dir, "documents", "doc_id", ["doc_id", "text", "lang"]), ParseSettings())


@_query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id::VARCHAR AS c0, text AS c1, lang AS c2 FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as one delimited file and read again, quoted line breaks and all."""
    scratch = Scratch(spark, "round-trip")
    settings = ParseSettings(line_ending="lf")
    sink.save(_cells(spark, sf_dir, "documents", "doc_id", ["doc_id", "text", "lang"]), scratch.at("documents.csv"), settings, ["doc_id", "text", "lang"])
    return Source(spark, scratch.at("documents.csv"), {"has_headers": True, "line_ending": "lf", "delimiter": ",", "quote": "double", "escape": "none"}).table()


@_query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, event_id::VARCHAR AS c0, event_type AS c1, props AS c2 FROM events")
def csv_split_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file read in many splits: ids are still dense and in file order."""
    scratch = Scratch(spark, "split-read")
    sink.save(_cells(spark, sf_dir, "events", "event_id", ["event_id", "event_type", "props"]), scratch.at("events.csv"), ParseSettings(delimiter="\t"), ["event_id", "event_type", "props"])
    return Source(spark, scratch.at("events.csv"), {"has_headers": True, "delimiter": "tab", "quote": "double", "escape": "none", "line_ending": "lf"}, reading="lines").table()


@_query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id::VARCHAR AS c0, text AS c1, lang AS c2 FROM documents")
def csv_record_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with quoted line breaks, divided at the ends of records."""
    scratch = Scratch(spark, "record-read")
    sink.save(_cells(spark, sf_dir, "documents", "doc_id", ["doc_id", "text", "lang"]), scratch.at("documents.csv"), ParseSettings(line_ending="lf"), ["doc_id", "text", "lang"])
    return Source(spark, scratch.at("documents.csv"), {"has_headers": True, "line_ending": "lf", "delimiter": ",", "quote": "double", "escape": "none"}, reading="records").table()


def _ragged(spark: SparkSession, sf_dir: str, malformed: str) -> Source:
    """A file of the 25 nations in which two of three records have a field too few or too many."""
    rows = _read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    lines = ["key,name,region"]
    for r in rows:
        cells = [str(r["n_nationkey"]), r["n_name"], str(r["n_regionkey"])]
        lines.append(",".join(cells[:2] if r["n_nationkey"] % 3 == 0 else cells + ["EXTRA"] if r["n_nationkey"] % 3 == 2 else cells))
    path = Scratch(spark, "ragged").at("ragged.csv")
    system, where = hadoop_path(spark, path)
    out = system.create(where, True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()
    return Source(spark, path, {"has_headers": True, "malformed": malformed, "delimiter": ","})


@_query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, n_nationkey::VARCHAR AS c0, n_name AS c1, n_regionkey::VARCHAR AS c2 FROM nation WHERE n_nationkey % 3 = 1")
def skip_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ragged(spark, sf_dir, "skip").table()


@_query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, n_nationkey::VARCHAR AS c0, n_name AS c1, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_regionkey::VARCHAR END AS c2 FROM nation")
def repair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ragged(spark, sf_dir, "repair").table()


@_query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS record, 'unequal-lengths' AS kind, 3::BIGINT AS expected_len, CASE n_nationkey % 3 WHEN 0 THEN 2 ELSE 4 END::BIGINT AS len FROM nation QUALIFY n_nationkey % 3 <> 1")
def parse_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ragged(spark, sf_dir, "skip").warnings().select("record", "kind", "expected_len", "len")


_LIMIT = 4096


@_query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, text FROM documents QUALIFY strlen(text) <= {_LIMIT}")
def size_policy_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_size_policy(_cells(spark, sf_dir, "documents", "doc_id", ["text"]), ParseSettings(max_field_size=_LIMIT))


@_query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, CASE WHEN strlen(text) <= {_LIMIT} THEN text ELSE substr(text, 1, list_max(list_filter(range({_LIMIT // 4}, {_LIMIT + 1}), lambda k: strlen(substr(text, 1, k)) <= {_LIMIT}))) END AS text FROM documents")
def size_policy_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_size_policy(_cells(spark, sf_dir, "documents", "doc_id", ["text"]), ParseSettings(max_field_size=_LIMIT, malformed="repair"))


@_query(f"SELECT * FROM ({_ORDER_ROWS}) WHERE row_id BETWEEN 5 AND 9 AND row_id <> 6")
def copied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a copy of a selection holds: rows in range, without the deleted."""
    pending = overlay.Overlay()
    pending.delete([6])
    return pending.apply(_order_rows(spark, sf_dir)).filter(overlay.in_ranges(F.col("row_id"), [(5, 9)]))
