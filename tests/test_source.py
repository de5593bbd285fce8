import pytest

from tablewright.operators import ordering, paging, search
from tablewright.sources import sink
from tablewright.sources.delimited import Source, from_table, with_size_policy
from tablewright.sources.settings import ParseSettings

RAGGED = 'a,b,c\n1,x,p\n2,y\n3,z,q,EXTRA\n4,,""\n5,w,r\n'


@pytest.fixture
def write(tmp_path):
    def file(content, name="t.csv"):
        path = tmp_path / name
        path.write_bytes(content.encode() if isinstance(content, str) else content)
        return str(path)

    return file


def cells(source, **options):
    return [tuple(r) for r in source.table().orderBy("row_id").collect()]


def test_skip_drops_and_ids_are_dense(spark, write):
    source = Source(spark, write(RAGGED), {"has_headers": True})
    assert cells(source) == [(0, "1", "x", "p"), (1, "4", "", ""), (2, "5", "w", "r")]
    table = source.table()
    assert table.count() == 3
    assert [r[0] for r in table.select("c0").collect()] == ["1", "4", "5"]
    assert [r[0] for r in search.search(table, "5", 0).collect()] == [2]
    assert ordering.sort_order(table, "c0", ascending=False).filter("display_idx = 0").first()["row_id"] == 2
    found = source.warnings().collect()
    assert [(w["record"], w["kind"], w["expected_len"], w["len"]) for w in found] == [(1, "unequal-lengths", 3, 2), (2, "unequal-lengths", 3, 4)]


def test_repair_pads_and_truncates(spark, write):
    rows = cells(Source(spark, write(RAGGED), {"has_headers": True, "malformed": "repair"}))
    assert rows == [(0, "1", "x", "p"), (1, "2", "y", ""), (2, "3", "z", "q"), (3, "4", "", ""), (4, "5", "w", "r")]


def test_strict_raises_whatever_is_read(spark, write):
    source = Source(spark, write(RAGGED), {"has_headers": True, "malformed": "strict"})
    for read in (lambda t: t.collect(), lambda t: t.count(), lambda t: t.select("c0").collect()):
        with pytest.raises(Exception, match="malformed record"):
            read(source.table())


def test_quoted_line_breaks_and_crlf(spark, write):
    assert cells(Source(spark, write(b'a,b\r\n1,"x\r\ny"\r\n'), {"has_headers": True})) == [(0, "1", "x\r\ny")]


def test_carriage_returns(spark, write):
    assert cells(Source(spark, write("a,b\r1,2\r3,4\r"))) == [(0, "1", "2"), (1, "3", "4")]


def test_byte_order_mark_and_no_header(spark, write):
    source = Source(spark, write(b"\xef\xbb\xbfName,Value\r\nAlice,1\r\n"), {"has_headers": False})
    assert source.metadata.headers == ["Column 1", "Column 2"]
    assert cells(source) == [(0, "Name", "Value"), (1, "Alice", "1")]


def test_undecodable_bytes_warn_and_stay(spark, write):
    source = Source(spark, write(b"n\nab\xff\ncd\n"), {"has_headers": True, "encoding": "utf-8", "line_ending": "lf"})
    assert [r[1] for r in cells(source)] == ["ab�", "cd"]
    assert [(w["record"], w["kind"], w["field"]) for w in source.warnings().collect()] == [(0, "utf8", 0)]
    with pytest.raises(Exception, match="utf8"):
        Source(spark, write(b"n\nab\xff\ncd\n"), {"has_headers": True, "encoding": "utf-8", "malformed": "strict"}).table().collect()


def test_latin_1_is_windows_1252(spark, write):
    source = Source(spark, write("a,b\ncafé €,1\n".encode("windows-1252")), {"encoding": "latin1", "has_headers": True})
    assert cells(source) == [(0, "café €", "1")]


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16le"])
def test_utf_16(spark, write, encoding):
    source = Source(spark, write("a,b\né,1\n2,ü\n".encode(encoding)), {"encoding": "utf-16le", "has_headers": True, "delimiter": ",", "line_ending": "lf"})
    assert cells(source) == [(0, "é", "1"), (1, "2", "ü")]


def test_size_limits(spark, write):
    text = "a,b\n123456789é,x\nok,y\n"  # the first cell has 11 bytes, the last character two of them
    given = {"has_headers": True, "max_field_size": 10}
    assert cells(Source(spark, write(text), given)) == [(0, "ok", "y")]
    assert cells(Source(spark, write(text), given | {"malformed": "repair"})) == [(0, "123456789", "x"), (1, "ok", "y")]
    with pytest.raises(Exception, match="max-field-size"):
        Source(spark, write(text), given | {"malformed": "strict"}).table().collect()
    short = {"has_headers": True, "max_record_size": 4, "malformed": "repair"}
    assert cells(Source(spark, write("a,b,c\n12,34,5\n"), short)) == [(0, "12", "34", "")]


@pytest.mark.parametrize("limit", range(1, 9))
def test_truncation_is_at_characters(spark, limit):
    texts = ["abcdefgh", "éééé", "a€€b", "😀😀", "", "aé€😀"]
    table = spark.createDataFrame(list(enumerate(texts)), "row_id long, c0 string")
    found = with_size_policy(table, ParseSettings(max_field_size=limit, malformed="repair")).orderBy("row_id").collect()
    assert [r["c0"] for r in found] == [t.encode()[:limit].decode(errors="ignore") for t in texts]


def test_warnings_are_the_first_200(spark, write):
    source = Source(spark, write("a,b\n" + "1\n" * 300 + "1,2\n"), {"has_headers": True, "delimiter": ","})
    found = source.warnings().collect()
    assert [w["record"] for w in found] == list(range(200))
    assert source.table().count() == 1


def test_malformed_rows_do_not_end_the_table(spark, write):
    lines = ["a,b"] + [f"{i}" if i % 50 == 0 and i < 10_000 else f"{i},x" for i in range(25_000)]
    source = Source(spark, write("\n".join(lines) + "\n"), {"has_headers": True, "delimiter": ","})
    table = source.table()
    assert table.count() == 24_800
    assert ordering.sort_order(table, "c0").count() == 24_800


def test_ids_do_not_depend_on_splits(spark, write):
    path = write("k\tv\n" + "".join(f"{i}\t{'x' * (i % 40)}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = {}
    for size in ("20k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        table = Source(spark, path, {"has_headers": True, "delimiter": "tab"}, reading="lines").table()
        found[size] = table.rdd.getNumPartitions(), [tuple(r) for r in table.orderBy("row_id").select("row_id", "c0").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found["20k"][0] > found["128m"][0]
    assert found["20k"][1] == found["128m"][1] == [(i, str(i)) for i in range(20_000)]


def test_written_cells(spark, tmp_path):
    rows = [(0, " lead ", "a,b"), (1, 'q"x', ""), (2, "l\nf", "é")]
    table = spark.createDataFrame(rows, "row_id long, c0 string, c1 string")
    path = str(tmp_path / "out.csv")
    sink.save(table, path, ParseSettings(line_ending="lf"), ["one", "t,wo"])
    assert open(path, newline="").read() == 'one,"t,wo"\n lead ,"a,b"\n"q""x",\n"l\nf",é'
    again = Source(spark, path, {"has_headers": True, "delimiter": ",", "quote": "double", "escape": "none", "line_ending": "lf"})
    assert cells(again) == rows
    assert again.metadata.headers == ["one", "t,wo"]


def test_empty_files_and_tables(spark, write, tmp_path):
    source = Source(spark, write("a,b\n"))
    assert source.table().count() == 0
    table = spark.createDataFrame([], "row_id long, c0 string")
    sink.save(table, str(tmp_path / "none.csv"), ParseSettings(line_ending="lf"), ["a"])
    assert (tmp_path / "none.csv").read_text() == "a"
    assert from_table(spark.createDataFrame([], "k long, v string"), "k").count() == 0
    assert paging.page(table, 0, 10).count() == 0


@pytest.mark.parametrize("size", [150, 1000, 1 << 20])
@pytest.mark.parametrize("ending", ["lf", "crlf"])
def test_records_cut_by_splits(spark, write, size, ending):
    """Quoted line breaks in a file that is divided anywhere, also with cells over several splits."""
    import random

    draw, end = random.Random(size), "\n" if ending == "lf" else "\r\n"
    cell = lambda: "".join(draw.choices(["a", "b", ",", '"', end, "é", " "], k=draw.randrange(8) if draw.random() < 0.95 else 400))
    rows = [(i, str(i), cell(), cell()) for i in range(60)]
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    text = "k,a,b" + end + "".join(f"{k},{quoted(a)},{quoted(b)}{end}" for _, k, a, b in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        given = {"has_headers": True, "delimiter": ",", "quote": "double", "escape": "none", "line_ending": ending}
        assert cells(Source(spark, write(text, f"r{size}{ending}.csv"), given, reading="records")) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_follow_the_policy(spark, write):
    path = write('a,b,c\n1,x,p\n\n2,y\n3,"z\nz",q,EXTRA\n4,,""\n5,"w\nw",r\n')
    found = {m: cells(Source(spark, path, {"has_headers": True, "malformed": m, "delimiter": ",", "line_ending": "lf"}, reading="records")) for m in ("skip", "repair")}
    assert found["skip"] == [(0, "1", "x", "p"), (1, "4", "", ""), (2, "5", "w\nw", "r")]
    assert found["repair"] == [(0, "1", "x", "p"), (1, "2", "y", ""), (2, "3", "z\nz", "q"), (3, "4", "", ""), (4, "5", "w\nw", "r")]
    warned = Source(spark, path, {"has_headers": True, "delimiter": ",", "line_ending": "lf"}, reading="records").warnings().collect()
    assert [(w["record"], w["kind"], w["len"]) for w in warned] == [(1, "unequal-lengths", 2), (2, "unequal-lengths", 4)]


def test_accented_letter_at_the_end_of_the_file(spark, write):
    source = Source(spark, write("a,b\n1,Café".encode("windows-1252")), {"has_headers": True, "delimiter": ","})
    assert source.settings.encoding == "windows-1252"
    assert cells(source) == [(0, "1", "Café")]


def test_unknown_encoding_labels_change_nothing(spark, write):
    source = Source(spark, write("a,b\n1,é\n"), {"has_headers": True, "encoding": "no-such-label"})
    assert source.settings.encoding == "utf-8"
    assert cells(source) == [(0, "1", "é")]


def test_the_way_to_divide_a_file(spark, write, monkeypatch):
    monkeypatch.setattr("tablewright.sources.delimited.SPLIT_BYTES", 0)
    given = {"has_headers": True, "delimiter": ",", "line_ending": "lf", "quote": "double", "escape": "none"}
    rows = 'a,b\n1,"x\ny ""z"""\n"2",""\n'
    for text, way in (("a,b\n1,x\n2,\n", "lines"), (rows, "records"), (rows + '3,5" wide\n4,6" wide\n', "whole"), (rows + '"3" ,x\n', "whole"), ("a,b\n1,é\n".encode("windows-1252"), "lines"), ('a,b\n1,"é"\n'.encode("windows-1252"), "whole")):
        source = Source(spark, write(text, f"w{len(text)}{way}.csv"), given)
        assert source.reading == way, text
        assert cells(source) == cells(Source(spark, source.path, given, reading="whole"))
    assert Source(spark, write("a,b\n1,x\n".encode("utf-16"), "u.csv"), given).reading == "whole"


def test_where_warnings_are(spark, write):
    text = '﻿a,b\r\n1,2\r\n\r\n"é\r\n",3\r\n4\r\n5,6,7\r\n'
    found = Source(spark, write(text), {"has_headers": True, "delimiter": ",", "quote": "double"}).warnings().collect()
    data = text.encode()
    assert [(r["record"], r["line"], data[r["byte"] : r["byte"] + 1], r["len"]) for r in found] == [(2, 6, b"4", 1), (3, 7, b"5", 3)]
    latin = Source(spark, write("a,b\n1\né,2\n".encode("windows-1252"), "l.csv"), {"has_headers": True, "delimiter": ","}).warnings().collect()
    assert [(r["record"], r["line"], r["byte"], r["len"]) for r in latin] == [(0, None, None, 1)]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(3, "a", 1.5), (1, "b", None), (2, None, 2.5)], "k long, name string, x double").write.parquet(f"{tmp_path}/t")
    table = from_table(spark.read.parquet(f"{tmp_path}/t"), "k")
    assert [tuple(r) for r in table.orderBy("row_id").collect()] == [(0, "1", "b", ""), (1, "2", "", "2.5"), (2, "3", "a", "1.5")]
    table = from_table(spark.read.parquet(f"{tmp_path}/t"), "k", fill=False)
    found = search.search(table.select("row_id", "name"), "a", 0, whole_cell=True, match_case=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,a)" in plan
    assert [r["row_id"] for r in found.collect()] == [2]
