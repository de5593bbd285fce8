"""Registered queries for what a session does beside reading rows: sniffing, policies, caches, edits, saving.

Each gives its outcome as rows, whose SQL says what must come out: from the tables where the
outcome depends on them, else as plain values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import ordering, overlay, paging
from tablewright.operators.artefacts import Artefacts, source_key
from tablewright.session import TableSession, initial_path
from tablewright.sources import sink, sniff
from tablewright.sources.delimited import Source, from_table
from tablewright.sources.settings import ParseSettings, with_overrides
from tablewright.storage import Scratch, hadoop_path

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__], _ORACLES[f.__name__] = f, sql
        return f

    return register


def _literal(value: object) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _values(columns: str, rows: Iterable[Sequence]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({columns})"


def _put(spark: SparkSession, path: str, content: bytes) -> str:
    system, where = hadoop_path(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def _get(spark: SparkSession, path: str) -> bytes:
    return sniff.read_sample(spark, path, 1 << 24)[0]


def _file(spark: SparkSession, sf_dir: str, name: str, key: str, columns: Sequence[str], settings: ParseSettings | None = None) -> str:
    """Some columns of a table as one delimited file, in the order of the key."""
    table = from_table(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns), key)
    path = Scratch(spark, "behaviour").at(f"{name}.csv")
    sink.save(table, path, settings or ParseSettings(line_ending="lf"), list(columns))
    return path


def _session(spark: SparkSession, path: str, **overrides: object) -> TableSession:
    session = TableSession(spark, Artefacts(spark, Scratch(spark, "behaviour").at("kept")))
    session.load(path, {"has_headers": True, "delimiter": ",", "quote": "double", "escape": "none", "line_ending": "lf"} | overrides)
    return session


def _fails(action: Callable[[], object]) -> bool:
    try:
        action()
    except PySparkException:
        return True
    return False


def _rows(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


# ---- sniffing

_ORDERS = ("o_orderkey", "o_orderstatus", "o_orderpriority")
_ORDERS_TEXT = f"(SELECT '{','.join(_ORDERS)}' || chr(10) || string_agg(concat_ws(',', {', '.join(_ORDERS)}), chr(10) ORDER BY o_orderkey) AS content FROM orders)"


@_query(f"""SELECT least(strlen(content), 65536)::BIGINT AS sample_bytes, strlen(content)::BIGINT AS length, 'utf-8' AS encoding, 'lf' AS line_ending, '"' AS quote, ',' AS delimiter, NULL::VARCHAR AS escape, 3 AS n_labels,
floor(strlen(content) / (least(strlen(content), 65536) / (length(left(content, 65536)) - length(replace(left(content, 65536), chr(10), '')))::DOUBLE))::BIGINT AS estimate FROM {_ORDERS_TEXT}""")
def sniff_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first 64 KiB of a file tell."""
    path = _file(spark, sf_dir, "orders", "o_orderkey", _ORDERS)
    found = sniff.sniff(spark, path)
    s = found.settings
    row = (len(found.sample), found.length, s.encoding, s.line_ending, s.quote, s.delimiter, s.escape, len(sniff.labels_of(found.sample, s)), sniff.estimated_rows(found.sample, found.length, s))
    return _rows(spark, [row], "sample_bytes long, length long, encoding string, line_ending string, quote string, delimiter string, escape string, n_labels int, estimate long")


#: Inputs of each rule, and what it must find.
_ENCODED = (
    ("utf-8 mark", b"\xef\xbb\xbfa", 4, "utf-8"), ("little-endian mark", b"\xff\xfea\x00", 4, "utf-16le"), ("big-endian mark", b"\xfe\xff\x00a", 4, "utf-16be"),
    ("ascii", b"abc", 3, "utf-8"), ("two bytes", "é".encode(), 2, "utf-8"), ("cut by the sample", b"abc\xc3", 9, "utf-8"),
    ("accent at the end", b"Caf\xe9", 4, "windows-1252"), ("accent inside", b"Caf\xe9 x", 6, "windows-1252"), ("empty", b"", 0, "utf-8"),
)


@_query(_values("input, encoding", [(name, wanted) for name, _, _, wanted in _ENCODED]))
def sniff_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(name, sniff.detect_encoding(sample, length)) for name, sample, length, _ in _ENCODED], "input string, encoding string")


_RULES: tuple[tuple[str, str, Callable[[], object], str], ...] = (
    ("line ending", "crlf", lambda: sniff.detect_line_ending("a\r\nb\r\nc\n"), "crlf"),
    ("line ending", "lf", lambda: sniff.detect_line_ending("a\nb\nc\r\n"), "lf"),
    ("line ending", "cr", lambda: sniff.detect_line_ending("a\rb\r"), "cr"),
    ("line ending", "none", lambda: sniff.detect_line_ending("abc"), "crlf"),
    ("line ending", "lf as often as cr", lambda: sniff.detect_line_ending("a\nb\r"), "lf"),
    ("quote", "double", lambda: sniff.detect_quote('"a"'), '"'),
    ("quote", "single", lambda: sniff.detect_quote("'a','b'\""), "'"),
    ("quote", "as many of both", lambda: sniff.detect_quote("'\""), '"'),
    ("quote", "none", lambda: sniff.detect_quote("a"), '"'),
    ("fields", "plain", lambda: sniff.count_fields("a,b,c", ",", '"'), "3"),
    ("fields", "quoted delimiter", lambda: sniff.count_fields('"a,b",c', ",", '"'), "2"),
    ("fields", "doubled quote", lambda: sniff.count_fields('"a"",b",c', ",", '"'), "2"),
    ("fields", "open quote", lambda: sniff.count_fields('"a,b', ",", '"'), "None"),
    ("fields", "blank", lambda: sniff.count_fields("  ", ",", '"'), "None"),
    ("delimiter", "semicolon", lambda: sniff.detect_delimiter("a;b\nc;d\n", '"'), ";"),
    ("delimiter", "tab", lambda: sniff.detect_delimiter("a\tb\nc\td\n", '"'), "\t"),
    ("delimiter", "tie goes to the comma", lambda: sniff.detect_delimiter("a,b;c\nd,e;f\n", '"'), ","),
    ("delimiter", "one line", lambda: sniff.detect_delimiter("a,b", '"'), "None"),
    ("delimiter", "more lines agree", lambda: sniff.detect_delimiter("a,b|c\nd|e\nf|g\n", '"'), "|"),
    ("escape", "backslash", lambda: sniff.detect_escape('"a\\"b"', '"'), "\\"),
    ("escape", "none", lambda: sniff.detect_escape('"a\\b"', '"'), "None"),
    ("numeric", "space around", lambda: sniff.is_numeric(" 1.5e3 "), "True"),
    ("numeric", "infinity", lambda: sniff.is_numeric("-inf"), "True"),
    ("numeric", "suffix", lambda: sniff.is_numeric("1d"), "False"),
    ("numeric", "empty", lambda: sniff.is_numeric(" "), "False"),
    ("header", "names over numbers", lambda: sniff.looks_like_header([["id", "x"], ["1", "2"]]), "True"),
    ("header", "all text", lambda: sniff.looks_like_header([["id", "name"], ["a", "b"]]), "False"),
    ("header", "words over some numbers", lambda: sniff.looks_like_header([["id", "a b", "c"], ["1", "x", "y"]]), "True"),
    ("header", "numbers", lambda: sniff.looks_like_header([["1", "2"], ["3", "4"]]), "False"),
    ("header", "one record", lambda: sniff.looks_like_header([["1", "2"]]), "True"),
    ("labels", "shown", lambda: "|".join(sniff.shown_labels([" id ", "", "x"])), "id|Column 2|x"),
    ("labels", "stored", lambda: "|".join(sniff.labels_of("﻿ id ,,x\n".encode(), ParseSettings())), " id ||x"),
    ("labels", "without a header", lambda: "|".join(sniff.labels_of(b"a,b\n", ParseSettings(has_headers=False))), "Column 1|Column 2"),
    ("estimate", "no line break", lambda: sniff.estimated_rows(b"abc", 3, ParseSettings()), "None"),
)


@_query(_values("rule, input, found", [(rule, name, wanted) for rule, name, _, wanted in _RULES]))
def sniff_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(rule, name, str(find())) for rule, name, find, _ in _RULES], "rule string, input string, found string")


_OVERRIDES = (
    ("delimiter", "pipe", "|"), ("delimiter", ";", ";"), ("delimiter", "ab", ","), ("quote", "single", "'"), ("quote", "", '"'), ("escape", "backslash", "\\"), ("escape", "off", "None"),
    ("line_ending", "CRLF", "crlf"), ("line_ending", "x", "auto"), ("encoding", "latin1", "windows-1252"), ("encoding", "no-such-label", "utf-8"), ("has_headers", False, "False"),
    ("malformed", "repair", "repair"), ("max_field_size", 10, "10"), ("max_record_size", 20, "20"),
)


@_query(_values("field, value, effective", [(f, str(v), w) for f, v, w in _OVERRIDES]))
def override_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that make sense replace what was found; others change nothing."""
    return _rows(spark, [(f, str(v), str(getattr(with_overrides(ParseSettings(), {f: v}), f))) for f, v, _ in _OVERRIDES], "field string, value string, effective string")


# ---- reading

_ENCODINGS = ("utf-8", "utf-16le", "utf-16be", "windows-1252")


@_query(f"SELECT e AS encoding, row_number() OVER (PARTITION BY e ORDER BY n_nationkey) - 1 AS row_id, n_name || 'é' AS c0 FROM nation, unnest([{', '.join(map(repr, _ENCODINGS))}]) t(e)")
def read_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file in several encodings."""
    names = [r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]
    scratch, found = Scratch(spark, "behaviour"), None
    for encoding in _ENCODINGS:
        path = _put(spark, scratch.at(f"{encoding}.csv"), "\n".join(["name", *[f"{n}é" for n in names], ""]).encode(encoding))
        rows = Source(spark, path, {"encoding": encoding, "has_headers": True, "delimiter": ",", "line_ending": "lf"}).table().withColumn("encoding", F.lit(encoding))
        found = rows if found is None else found.unionByName(rows)
    return found.select("encoding", "row_id", "c0")


_NATION = ("n_nationkey", "n_name", "n_regionkey")
_SIZED = "SELECT n_nationkey::VARCHAR AS c0, n_name AS c1, n_regionkey::VARCHAR AS c2, strlen(n_nationkey::VARCHAR) AS s0, strlen(n_name) AS s1, strlen(n_regionkey::VARCHAR) AS s2, n_nationkey FROM nation"


def _nations(spark: SparkSession, sf_dir: str, **overrides: object) -> Source:
    given = {"has_headers": True, "delimiter": ",", "quote": "double", "escape": "none", "line_ending": "lf"}
    return Source(spark, _file(spark, sf_dir, "nation", "n_nationkey", _NATION), given | overrides)


@_query(f"SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, c0, c1, c2 FROM ({_SIZED}) WHERE s1 <= 12 AND s0 + s1 + s2 <= 10")
def read_sizes_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a long field, or long as a whole, are left out of a file."""
    return _nations(spark, sf_dir, max_field_size=12, max_record_size=10).table()


@_query(f"SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, c0, CASE WHEN s0 + least(s1, 7) <= 9 THEN left(c1, 7) ELSE '' END AS c1, CASE WHEN s0 + least(s1, 7) + s2 <= 9 THEN c2 ELSE '' END AS c2 FROM ({_SIZED})")
def read_sizes_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long fields are cut, then whole trailing fields dropped."""
    return _nations(spark, sf_dir, malformed="repair", max_field_size=7, max_record_size=9).table()


@_query(_values("fault, strict_fails", [("none", False), ("field size", True), ("record size", True), ("length", True), ("encoding", True)]))
def read_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict reading raises at the first malformed record."""
    scratch, strict = Scratch(spark, "behaviour"), {"malformed": "strict", "has_headers": True, "delimiter": ",", "line_ending": "lf", "encoding": "utf-8"}
    tries = {
        "none": _nations(spark, sf_dir, malformed="strict"),
        "field size": _nations(spark, sf_dir, malformed="strict", max_field_size=5),
        "record size": _nations(spark, sf_dir, malformed="strict", max_record_size=9),
        "length": Source(spark, _put(spark, scratch.at("length.csv"), b"a,b\n1,2\n3\n"), strict),
        "encoding": Source(spark, _put(spark, scratch.at("bytes.csv"), b"a,b\n1,\xff\n"), strict),
    }
    return _rows(spark, [(name, _fails(lambda s=source: s.table().collect())) for name, source in tries.items()], "fault string, strict_fails boolean")


#: A missing number is shown as -1.
_FAULTS = [(0, 2, 4, 1, "utf8", -1, -1), (1, 3, 8, 0, "max-field-size", 4, 6), (1, 3, 8, -1, "max-record-size", 6, 7), (2, 4, 17, -1, "unequal-lengths", 2, 3)]


@_query(f"SELECT record::BIGINT AS record, line::BIGINT AS line, byte::BIGINT AS byte, field::BIGINT AS field, kind, expected_len::BIGINT AS expected_len, len::BIGINT AS len FROM ({_values('record, line, byte, field, kind, expected_len, len', _FAULTS)})")
def read_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One warning for each record and kind, and where it begins in the file."""
    path = _put(spark, Scratch(spark, "behaviour").at("faults.csv"), b"a,b\n1,\xff\n123456,7\n1,2,3\n")
    return Source(spark, path, {"has_headers": True, "delimiter": ",", "line_ending": "lf", "encoding": "utf-8", "max_field_size": 4, "max_record_size": 6}).warnings().drop("message").fillna(-1)


@_query("SELECT row_id, c0, c1 FROM (VALUES (0, '1', chr(65533)), (1, '2', 'é')) t(row_id, c0, c1)")
def read_undecodable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that do not decode are replaced; the row stays."""
    path = _put(spark, Scratch(spark, "behaviour").at("bytes.csv"), b"a,b\n1,\xff\n2,\xc3\xa9\n")
    return Source(spark, path, {"has_headers": True, "delimiter": ",", "line_ending": "lf", "encoding": "utf-8"}).table()


@_query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id::VARCHAR AS c0, text AS c1, lang AS c2, source AS c3, n_chars::VARCHAR AS c4 FROM documents")
def read_large_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file is divided among tasks as its quotes allow, quoted line breaks and all: here by records."""
    from tablewright.sources import delimited

    path = _file(spark, sf_dir, "documents", "doc_id", ("doc_id", "text", "lang", "source", "n_chars"))
    given = {"has_headers": True, "line_ending": "lf", "delimiter": ",", "quote": "double", "escape": "none"}
    source = Source(spark, path, given, reading=delimited.way(spark, path, with_overrides(ParseSettings(), given)))
    if source.reading != "records":
        raise ValueError(f"divided by {source.reading}")
    return source.table()


# ---- pages, searches and duplicates of a session


@_query(f"SELECT n AS page, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey::VARCHAR AS c0, o_orderstatus AS c1, o_orderpriority AS c2, 2 AS reads FROM orders, (VALUES (1), (2), (3)) t(n) WHERE false UNION ALL SELECT CASE WHEN row_id < 800 THEN 1 ELSE 2 END, row_id, o_orderkey::VARCHAR, o_orderstatus, o_orderpriority, 2 FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders) WHERE row_id < {2 * paging.PAGE_ROWS}")
def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of a session, each asked for twice and read once."""
    session = _session(spark, _file(spark, sf_dir, "orders", "o_orderkey", _ORDERS))
    reads, get = [], session.pages.get
    session.pages.get = lambda key, read: get(key, lambda: (reads.append(key), read())[1])
    pages = [session.chunk(n * paging.PAGE_ROWS, paging.PAGE_ROWS) for n in (0, 1, 0, 1)][2:]
    rows = [(n + 1, n * paging.PAGE_ROWS + i, *cells, len(reads)) for n, page in enumerate(pages) for i, cells in enumerate(page)]
    return _rows(spark, rows, "page int, row_id long, c0 string, c1 string, c2 string, reads int")


@_query(f"SELECT ((row_number() OVER (ORDER BY row_id) - 1) // {paging.ID_CHUNK})::BIGINT AS part, row_id FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, event_type FROM events) WHERE contains(lower(event_type), 'c')")
def search_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a session in parts of at most 5000 ids."""
    session = _session(spark, _file(spark, sf_dir, "events", "event_id", ("event_id", "event_type")))
    return _rows(spark, [(n, i) for n, part in enumerate(session.search_stream("C", 1)) for i in part], "part long, row_id long")


@_query(f"SELECT ((row_number() OVER (ORDER BY row_id) - 1) // {paging.ID_CHUNK})::BIGINT AS part, row_id FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE n > 1")
def duplicates_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for duplicates in one column; no index has to be whole before."""
    session = _session(spark, _file(spark, sf_dir, "events", "event_id", ("event_id", "event_type")))
    return _rows(spark, [(n, i) for n, part in enumerate(session.duplicates_stream(1)) for i in part], "part long, row_id long")


@_query("SELECT indexed, row_id FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_mktsegment FROM customer), (VALUES (true), (false)) t(indexed) WHERE lower(c_mktsegment) = 'building'")
def index_on_and_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search gives the same with the index and after it is switched off."""
    session = _session(spark, _file(spark, sf_dir, "customer", "c_custkey", ("c_custkey", "c_mktsegment")))
    session.build_index()
    found = session.search("BUILDING", 1, whole_cell=True).withColumn("indexed", F.lit(session._index is not None))
    session.set_indexing(False)
    return found.union(session.search("BUILDING", 1, whole_cell=True).withColumn("indexed", F.lit(session._index is not None)))


_PARTS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@_query(f"SELECT row_id FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part) WHERE {' OR '.join(f'contains(lower({c}::VARCHAR), {chr(39)}77{chr(39)})' for c in _PARTS)}")
def search_every_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in any of all columns of a table."""
    from tablewright.operators import search

    return search.search(from_table(spark.read.parquet(f"{sf_dir}/part.parquet").select(*_PARTS), "p_partkey"), "77")


@_query("SELECT row_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, count(*) OVER (PARTITION BY coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''), coalesce(n_chars::VARCHAR, '')) AS n FROM documents) WHERE n > 1")
def dups_whole_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by all cells of rows but their identifier."""
    from tablewright.operators import duplicates

    table = from_table(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")
    return duplicates.duplicates(table.drop("doc_id"))


# ---- orders of a session


@_query(f"""SELECT step, display_idx, row_id FROM (
SELECT 'sorted' AS step, row_number() OVER (ORDER BY c_name, row_id) - 1 AS display_idx, row_id FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer)
UNION ALL SELECT 'kept', row_number() OVER (ORDER BY c_name, row_id) - 1, row_id FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer)
UNION ALL SELECT 'cleared', row_id, row_id FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer)) WHERE display_idx < 100""")
def kept_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a sorted session, of another that finds the order kept, and without a sort."""
    path = _file(spark, sf_dir, "customer", "c_custkey", ("c_custkey", "c_name"))
    session = _session(spark, path)
    session.sort_by(1)
    again = TableSession(spark, session.artefacts)
    again.load(path, {"has_headers": True, "delimiter": ",", "quote": "double", "escape": "none", "line_ending": "lf"})
    if session.artefacts.get(again.key, "order-1-asc") is None:
        raise ValueError("the order was not kept")
    again.sort_by(1)
    steps = [("sorted", session.sorted_ids(0, 100)), ("kept", again.sorted_ids(0, 100))]
    again.clear_sort()
    steps.append(("cleared", again.sorted_ids(0, 100)))
    return _rows(spark, [(step, i, row_id) for step, found in steps for i, row_id in enumerate(found)], "step string, display_idx long, row_id long")


@_query(_values("click, sorted_column, ascending", [(1, 2, True), (2, 2, False), (3, -1, True), (4, 0, True), (5, 1, True), (6, 1, True)]))
def header_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascending, descending, none (shown as -1); another column; nothing while rows are not counted."""
    state, rows = ordering.SortState(), []
    for n, (column, ready) in enumerate([(2, True), (2, True), (2, True), (0, True), (1, True), (1, False)], 1):
        state = state.clicked(column, ready)
        rows.append((n, -1 if state.column is None else state.column, state.ascending))
    return _rows(spark, rows, "click int, sorted_column int, ascending boolean")


# ---- edits, copies and saving

_EDITS = [("new value", True), ("same again", False), ("another value", True), ("original value", True), ("no edits left", True), ("of a deleted row", False), ("after restoring", True), ("of no row", False)]


@_query(_values("edit, changed", _EDITS))
def edit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which edits of a session change anything."""
    session = _session(spark, _file(spark, sf_dir, "nation", "n_nationkey", _NATION))
    original = session.rows_by_id([3])[0][1]
    found = [session.edit(3, 1, "x"), session.edit(3, 1, "x"), session.edit(3, 1, "y"), session.edit(3, 1, original), not session.overlay.dirty]
    session.delete_selection([(3, 3)])
    found.append(session.edit(3, 1, "z"))
    session.restore_selection([(3, 3)])
    found += [session.edit(3, 1, "z"), session.edit(10**9, 1, "z")]
    return _rows(spark, zip([name for name, _ in _EDITS], found, strict=True), "edit string, changed boolean")


@_query("SELECT with_edits, row_id FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, n_name FROM nation), (VALUES (true), (false)) t(with_edits) WHERE CASE WHEN with_edits THEN row_id <> 1 AND (row_id = 4 OR contains(lower(n_name), '1')) ELSE contains(lower(n_name), '1') END")
def search_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search reads the file; on request, the view with its edits and without deleted rows."""
    session = _session(spark, _file(spark, sf_dir, "nation", "n_nationkey", _NATION))
    session.edit(4, 1, "41 x")
    session.delete_selection([(1, 1)])
    return session.search("1", 1).withColumn("with_edits", F.lit(False)).union(session.search("1", 1, include_edits=True).withColumn("with_edits", F.lit(True)))


@_query("SELECT row_number() OVER (ORDER BY n_name DESC, n_nationkey) - 1 AS display_idx, row_id AS original FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id FROM nation) QUALIFY display_idx < 5")
def original_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are shown at the first places of a sorted view."""
    session = _session(spark, _file(spark, sf_dir, "nation", "n_nationkey", _NATION))
    session.sort_by(1, ascending=False)
    return _rows(spark, [(i, session.original_row(i)) for i in range(5)], "display_idx long, original long")


@_query("""SELECT string_agg(line, chr(13) || chr(10) ORDER BY display_idx) AS copied FROM (
SELECT n_nationkey || ',' || CASE WHEN row_id = 4 THEN '"a ""b"", c"' ELSE n_name END || ',' || n_regionkey AS line, row_number() OVER (ORDER BY n_name DESC, row_id) - 1 AS display_idx, row_id
FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id FROM nation)) WHERE display_idx BETWEEN 2 AND 20 AND row_id <> 7""")
def copied_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection of a sorted view as text: as shown, edited, without deleted rows, with the file's line ends."""
    path = _file(spark, sf_dir, "nation", "n_nationkey", _NATION, ParseSettings(line_ending="crlf"))
    session = _session(spark, path, line_ending="crlf")
    session.edit(4, 1, 'a "b", c')
    session.overlay.delete([7])
    session.sort_by(1, ascending=False)
    return _rows(spark, [(session.copy_selection([(2, 20)]),)], "copied string")


_SAVED = "(SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id FROM nation)"


@_query(f"""SELECT ending, 'n_nationkey;n_name;n_regionkey' || br || replace(string_agg(n_nationkey || ';' || CASE WHEN row_id = 1 THEN '"x;y"' ELSE n_name END || ';' || n_regionkey, chr(10) ORDER BY row_id), chr(10), br) AS content, ending = 'lf' AS clean, count(*)::BIGINT AS n_rows
FROM {_SAVED}, (VALUES ('lf', chr(10)), ('cr', chr(13)), ('crlf', chr(13) || chr(10))) t(ending, br) WHERE row_id <> 2 GROUP BY ending, br""")
def saved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file saved with each line ending; saved onto itself (here with LF) it is read anew and nothing is pending."""
    scratch, rows = Scratch(spark, "behaviour"), []
    for ending in ("lf", "cr", "crlf"):
        path = _file(spark, sf_dir, "nation", "n_nationkey", _NATION, ParseSettings(delimiter=";", line_ending=ending))
        session = _session(spark, path, delimiter=";", line_ending=ending)
        session.edit(1, 1, "x;y")
        session.delete_selection([(2, 2)])
        target = None if ending == "lf" else scratch.at(f"{ending}.csv")
        session.save(target)
        rows.append((ending, _get(spark, target or path).decode(), not session.overlay.dirty, session.view().count()))
    return _rows(spark, rows, "ending string, content string, clean boolean, n_rows long")


# ---- kept artefacts, warnings, launch

_KEYS = [("again", True), ("another delimiter", False), ("another way of reading", False), ("another size limit", False), ("the file changed", False)]


@_query(_values("source, same_key", _KEYS))
def artefact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a kept copy belongs to."""
    path = _put(spark, Scratch(spark, "behaviour").at("a.csv"), b"a,b\n1,2\n")
    first, plain = source_key(spark, path, ParseSettings()), ParseSettings()
    found = [source_key(spark, path, plain), source_key(spark, path, ParseSettings(delimiter=";")), source_key(spark, path, plain, "lines"), source_key(spark, path, ParseSettings(max_field_size=1))]
    _put(spark, path, b"a,b\n1,2\n3,4\n")
    found.append(source_key(spark, path, plain))
    return _rows(spark, [(name, key == first) for (name, _), key in zip(_KEYS, found, strict=True)], "source string, same_key boolean")


@_query(_values("step, n", [("rows made", 1), ("rows found", 1), ("order of another direction", 0), ("pruned too early", 0), ("pruned", 1), ("left", 0)]))
def kept_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and orders are made once, belong to a column and direction, and go after some days."""
    kept, table, made = Artefacts(spark, Scratch(spark, "behaviour").at("kept")), spark.createDataFrame([(0, "x")], "row_id long, c0 string"), []
    make = lambda: (made.append(1), table)[1]
    kept.rows("key", make)
    steps = [("rows made", len(made))]
    kept.rows("key", make)
    steps.append(("rows found", len(made)))
    kept.order("key", 0, True, lambda: ordering.sort_order(table, "c0"))
    steps += [("order of another direction", int(kept.get("key", "order-0-desc") is not None)), ("pruned too early", len(kept.prune())), ("pruned", len(kept.prune(now=4e9))), ("left", int(kept.get("key", "rows") is not None))]
    return _rows(spark, steps, "step string, n int")


@_query(_values("step, n", [("first", 2), ("cleared", 2), ("after", 0)]))
def session_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings stay until they are cleared."""
    session = _session(spark, _put(spark, Scratch(spark, "behaviour").at("w.csv"), b"a,b\n1\n2,3\n4,5,6\n"))
    return _rows(spark, [("first", len(session.warnings())), ("cleared", len(session.warnings(clear=True))), ("after", len(session.warnings()))], "step string, n int")


_LAUNCHES = [("x a.CSV b.csv", "a.CSV", True), ("x.txt", None, True), ("", None, True)]


@_query(_values("arguments, path, taken_once", _LAUNCHES))
def launch_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for arguments, _, _ in _LAUNCHES:
        session = TableSession(spark, pending=initial_path(arguments.split()))
        rows.append((arguments, session.take_pending_open(), session.take_pending_open() is None))
    return _rows(spark, rows, "arguments string, path string, taken_once boolean")


@_query(_values("step, ranges", [("normalised", "1-7"), ("taken out", "1-3 5-7"), ("put back", "1-7"), ("added", "1-7 9-12"), ("subtracted", "1-2 6-7"), ("selected", "True False")]))
def range_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections as ranges: merged, split, added to and taken from."""
    shown = lambda ranges: " ".join(f"{a}-{b}" for a, b in ranges)
    whole = overlay.normalised([(5, 7), (2, 1), (3, 4)])
    split = overlay.toggled(whole, 4)
    rows = [("normalised", shown(whole)), ("taken out", shown(split)), ("put back", shown(overlay.toggled(split, 4))), ("added", shown(overlay.added(whole, (12, 9)))), ("subtracted", shown(overlay.subtracted(whole, [(3, 5)])))]
    return _rows(spark, [*rows, ("selected", f"{overlay.is_selected(split, 3)} {overlay.is_selected(split, 4)}")], "step string, ranges string")


@_query(_values("start, n_matches, forward, found", [(0, 3, True, 1), (2, 3, True, 0), (0, 3, False, 2), (0, 0, True, -1)]))
def next_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next and the previous match, round the ends; -1 without any."""
    from tablewright.operators.search import step_match

    return _rows(spark, [(c, n, f, -1 if (found := step_match(c, n, f)) is None else found) for c, n, f in [(0, 3, True), (2, 3, True), (0, 3, False), (0, 0, True)]], "start int, n_matches int, forward boolean, found int")
