import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators import duplicates, ordering, overlay, paging, search
from tablewright.operators.artefacts import Artefacts, source_key
from tablewright.session import TableSession, initial_path
from tablewright.sources import sink
from tablewright.sources.settings import ParseSettings


def table(spark, rows, width=1):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long" + "".join(f", c{i} string" for i in range(width)))


def ids(found):
    return sorted(r["row_id"] for r in found.collect())


def test_whole_cell_and_contains(spark):
    t = table(spark, [("alpha",), ("alphabet",), ("beta",)])
    assert ids(search.search(t, "ALPHA", 0, whole_cell=True)) == [0]
    assert ids(search.search(t, "Alpha", 0)) == [0, 1]
    assert ids(search.search(t, "Alpha", 0, match_case=True)) == []
    assert ids(search.search(t, "a", 7)) == []
    assert ids(search.search(t, "", 0)) == [0, 1, 2]
    assert ids(search.search(t, "", 0, whole_cell=True)) == []


def test_any_column_and_absent_cells(spark):
    t = table(spark, [("alpha", "bravo"), ("charlie", "AlphaBeta"), (None, "echo")], 2)
    assert ids(search.search(t, "alpha", 1)) == [1]
    assert ids(search.search(t, "alpha")) == [0, 1]
    assert ids(search.search(t, "", 0)) == [0, 1]


def test_index_agrees_with_a_scan_beyond_its_key(spark):
    long = "x" * 300
    t = table(spark, [(long + "a",), (long + "b",), ("Short",), ("",)])
    index = search.SearchIndex(t)
    for query in (long + "A", "short", "xb", "", "none"):
        for whole in (False, True):
            assert ids(index.search(query, 0, whole_cell=whole)) == ids(search.search(t, query, 0, whole_cell=whole))
    assert ids(index.search("a", 5)) == []


def test_order_is_by_bytes_with_ids_for_ties(spark):
    values = ["b", "a", "B", "é", "10", "9", "", "Z", "a"]
    t = table(spark, [(v,) for v in values])
    up = {r["row_id"]: r["display_idx"] for r in ordering.sort_order(t, "c0").collect()}
    down = {r["row_id"]: r["display_idx"] for r in ordering.sort_order(t, "c0", ascending=False).collect()}
    expected = sorted(range(len(values)), key=lambda i: (values[i].encode(), i))
    assert sorted(up, key=up.get) == expected
    assert sorted(down, key=down.get) == sorted(range(len(values)), key=lambda i: ([-b for b in values[i].encode()] + [1], i))
    page = ordering.sorted_page(t, "c0", 2, 3).orderBy("display_idx").collect()
    assert [r["row_id"] for r in page] == expected[2:5]
    places = ordering.display_places(ordering.sort_order(t, "c0"), t.filter("row_id < 3")).collect()
    assert {(r["row_id"], r["display_idx"]) for r in places} == {(i, up[i]) for i in range(3)}


def test_ids_in_the_order_asked(spark):
    t = table(spark, [("a",), ("b",), ("c",)])
    found = paging.rows_by_id(t, [2, 0, 2, 9]).collect()
    assert [(r["position"], r["row_id"], r["c0"]) for r in found] == [(0, 2, "c"), (1, 0, "a"), (2, 2, "c"), (3, 9, None)]
    assert paging.rows_by_id(t, []).count() == 0


def test_pages_join_to_the_table(spark):
    t = table(spark, [(str(i),) for i in range(25)])
    read = [r["row_id"] for s in range(0, 30, 10) for r in paging.page(t, s, 10).collect()]
    assert read == list(range(25))


def test_chunks(spark):
    t = table(spark, [(str(i),) for i in range(11)])
    assert list(paging.id_chunks(t, 5)) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10]]


def test_page_cache_evicts_the_oldest():
    cache, read = paging.PageCache(1), []
    for key in ((0, 1), (1, 1), (1, 1), (0, 1)):
        cache.get(key, lambda key=key: read.append(key))
    assert read == [(0, 1), (1, 1), (0, 1)]
    cache.clear()
    assert not cache.pages


def test_duplicates(spark):
    t = table(spark, [("1", "Alice"), ("2", "Bob"), ("1", "Alice"), ("3", "Charlie"), ("2", "Bob"), ("2", "bob"), (None, "x"), (None, "x"), ("", "x")], 2)
    assert ids(duplicates.duplicates(t)) == [0, 1, 2, 4, 6, 7]
    assert ids(duplicates.duplicates(t, ["c0"])) == [0, 1, 2, 4, 5, 6, 7]


def test_matches_wrap():
    assert [search.step_match(i, 3) for i in range(3)] == [1, 2, 0]
    assert search.step_match(0, 3, forward=False) == 2
    assert search.step_match(0, 0) is None


def test_header_cycles():
    state = ordering.SortState()
    seen = [state := state.clicked(1) for _ in range(3)]
    assert seen == [ordering.SortState(1, True), ordering.SortState(1, False), ordering.SortState()]
    assert ordering.SortState(1, False).clicked(2) == ordering.SortState(2, True)
    assert ordering.SortState().clicked(1, ready=False) == ordering.SortState()


def test_overlay(spark):
    pending = overlay.Overlay()
    assert not pending.commit(0, 0, "a", "a")
    assert pending.commit(0, 0, "b", "a")
    assert not pending.commit(0, 0, "b", "a")
    assert pending.commit(0, 0, "a", "a")
    assert not pending.dirty
    pending.commit(1, 1, "new", "y")
    pending.delete([2])
    assert not pending.commit(2, 0, "z", "c")
    t = table(spark, [("a", "x"), ("b", "y"), ("c", "z")], 2)
    assert [tuple(r) for r in pending.apply(t).orderBy("row_id").collect()] == [(0, "a", "x"), (1, "b", "new")]
    pending.restore([2])
    assert pending.apply(t).count() == 3


def test_ranges():
    ranges = overlay.normalised([(5, 7), (1, 2), (3, 4)])
    assert ranges == [(1, 7)]
    assert overlay.toggled(ranges, 6) == [(1, 5), (7, 7)]
    assert overlay.toggled([(1, 5), (7, 7)], 6) == [(1, 7)]
    assert overlay.added([(1, 2)], (9, 8)) == [(1, 2), (8, 9)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=6), st.integers(0, 30))
def test_ranges_are_sets(ranges, row):
    inside = {i for a, b in ranges for i in range(min(a, b), max(a, b) + 1)}
    assert {i for a, b in overlay.normalised(ranges) for i in range(a, b + 1)} == inside
    assert {i for a, b in overlay.toggled(ranges, row) for i in range(a, b + 1)} == inside ^ {row}


def test_artefacts(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,2\n")
    key = source_key(spark, str(path), ParseSettings())
    assert key == source_key(spark, str(path), ParseSettings())
    assert key != source_key(spark, str(path), ParseSettings(delimiter=";"))
    kept, t = Artefacts(spark, str(tmp_path / "kept")), table(spark, [("x",)])
    order = kept.order(key, 0, True, lambda: ordering.sort_order(t, "c0"))
    assert order.count() == 1
    assert kept.order(key, 0, True, lambda: pytest.fail("kept already")).count() == 1
    assert kept.get(key, "order-0-desc") is None
    assert kept.get(key, "order-1-asc") is None
    assert kept.prune() == []
    assert kept.prune(now=4e9) == [key]
    assert kept.get(key, "order-0-asc") is None


def test_session(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_bytes(b"id,name\r\n3,Carol\r\n1,Alice\r\n2,bob\r\n1,Alice\r\n")
    session = TableSession(spark, pending=initial_path(["x", str(path)]))
    assert session.take_pending_open() == str(path)
    assert session.take_pending_open() is None
    found = session.load(str(path))
    assert (found.headers, found.effective.line_ending, found.estimated_count) == (["id", "name"], "crlf", 5)
    assert session.row_count() == 4
    assert session.chunk(1, 2) == [["1", "Alice"], ["2", "bob"]]
    assert session.rows_by_id([2, 9]) == [["2", "bob"], []]
    assert list(session.search_stream("ali", 1)) == [[1, 3]]
    session.build_index()
    assert list(session.search_stream("BOB", 1, whole_cell=True)) == [[2]]
    assert list(session.duplicates_stream()) == [[1, 3]]
    session.sort_by(0)
    assert session.sorted_ids(0, 4) == [1, 3, 2, 0]
    assert session.sorted_chunk(2, 2) == [(2, ["2", "bob"]), (0, ["3", "Carol"])]
    assert session.original_row(3) == 0
    assert session.edit(1, 1, "Ann, A.")
    session.delete_selection([(1, 1)])
    assert session.overlay.deleted == {3}
    assert session.copy_selection([(0, 2)]) == '1,"Ann, A."\r\n2,bob'
    assert session.search("Ann").count() == 0
    assert session.search("Ann", include_edits=True).count() == 1
    session.save(str(tmp_path / "copy.csv"))
    assert (tmp_path / "copy.csv").read_bytes() == b'id,name\r\n3,Carol\r\n1,"Ann, A."\r\n2,bob'
    assert session.overlay.dirty
    session.save()
    assert session.row_count() == 3
    assert not session.overlay.dirty
    assert session.warnings() == []


def test_following_a_folder(spark, tmp_path):
    from tablewright.streaming.follow import follow, matching

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n1,Apple\nbad\n2,pear\n")
    rows = follow(spark, str(tmp_path / "in"), 2, ParseSettings(line_ending="lf"))
    query = matching(rows, "APP", 1).writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("followed").collect()] == [("a.csv", "1", "Apple")]


def test_large_selections_stay_ranges_or_tables(spark, monkeypatch, tmp_path):
    pending, t = overlay.Overlay(), spark.range(1000).withColumnRenamed("id", "row_id").withColumn("c0", F.lit("x"))
    pending.delete_rows([(0, 799), (900, 10**12)])
    pending.restore_rows([(100, 199)])
    assert [r["row_id"] for r in pending.apply(t).orderBy("row_id").collect()] == [*range(100, 200), *range(800, 900)]
    pending.clear()
    pending.delete(range(0, 1000, 2))
    assert pending.apply(t).count() == 500
    # Tables keep their place among later changes.
    pending.clear()
    pending.delete([5])
    pending.delete_rows(t.filter("row_id % 10 = 0").select("row_id"))
    pending.restore([10, 20])
    pending.delete_rows([(0, 3), (20, 20)])
    left = {r["row_id"] for r in pending.apply(t).collect()}
    assert left == set(range(1000)) - {5, *range(0, 1000, 10), *range(4)} | {10}
    assert pending.deleted == set(range(1000)) - left
    assert (pending.can_edit(10), pending.can_edit(20), pending.can_edit(30), pending.can_edit(31)) == (True, False, False, True)

    path = tmp_path / "n.csv"
    path.write_text("n,m\n" + "".join(f"{i},{99 - i}\n" for i in range(100)))
    monkeypatch.setattr("tablewright.session.FEW_ROWS", 10)
    session = TableSession(spark)
    session.load(str(path), {"has_headers": True, "delimiter": ","})
    session.sort_by(1, ascending=False)
    session.delete_selection([(0, 10**9)])
    assert session.view().count() == 0
    session.restore_selection([(0, 4)])
    assert {r["row_id"] for r in session.view().collect()} == set(session.sorted_ids(0, 5))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=5), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=5))
def test_subtracted(ranges, other):
    inside = lambda rs: {i for a, b in rs for i in range(min(a, b), max(a, b) + 1)}
    assert inside(overlay.subtracted(ranges, other)) == inside(ranges) - inside(other)


def test_a_way_of_reading_has_its_own_copy(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_bytes(b'a,b\n1,"x\ny"\n')
    session = TableSession(spark)
    given = {"has_headers": True, "delimiter": ",", "line_ending": "lf"}
    session.load(str(path), given, reading="lines")
    broken = session.chunk(0, 9)
    session.load(str(path), given)
    assert session.chunk(0, 9) == [["1", "x\ny"]] != broken


class _Files:
    """A file system that refuses some renames."""

    def __init__(self, refused):
        self.names, self.refused = {"old": "old", "made": "new"}, refused

    def exists(self, name):
        return name in self.names

    def rename(self, a, b):
        if (str(a).split(".")[0], str(b).split(".")[0]) == self.refused:
            return False
        self.names[b] = self.names.pop(a)
        return True

    def delete(self, name, _):
        del self.names[name]


class _Name(str):
    def suffix(self, end):
        return _Name(self + end)


def test_a_failed_rename_loses_nothing():
    files = _Files(None)
    sink.replace(files, _Name("made"), _Name("old"))
    assert files.names == {"old": "new"}
    files = _Files(("made", "old"))
    with pytest.raises(OSError, match="made"):
        sink.replace(files, _Name("made"), _Name("old"))
    assert files.names == {"old": "old", "made": "new"}
