import pytest

from tablewright.sources import sniff
from tablewright.sources.settings import ParseSettings, with_overrides


@pytest.mark.parametrize(("text", "expected"), [("a;b\n1;2\n3;4\n", ";"), ("a,b;c\n1,2;3\n4,5;6\n", ","), ("a\tb\n1\t2\n", "\t"), ("one\ntwo\n", None)])
def test_delimiter_prefers_the_earlier_of_equals(text, expected):
    assert sniff.detect_delimiter(text, '"') == expected


def test_quoted_delimiters_do_not_count():
    assert sniff.count_fields("'x,y','z'", ",", "'") == 2
    assert sniff.count_fields("'x''y',z", ",", "'") == 2
    assert sniff.count_fields("'open,z", ",", "'") is None
    assert sniff.count_fields("  ", ",", '"') is None


@pytest.mark.parametrize(("text", "expected"), [("'a','b'", "'"), ('"a"', '"'), ("a", '"'), ("'a' \"b\"", '"'), ("'''\"", "'")])
def test_quote(text, expected):
    assert sniff.detect_quote(text) == expected


def test_escape():
    assert sniff.settings_of(b'a,b\n1,"he \\"x\\" y"\n').escape == "\\"
    assert sniff.settings_of(b"a,b\n1,2\n").escape is None


@pytest.mark.parametrize(("text", "expected"), [("a\rb\r", "cr"), ("a\nb\n", "lf"), ("a\r\nb\r\n", "crlf"), ("abc", "crlf"), ("a\r\nb\n", "crlf")])
def test_line_ending(text, expected):
    assert sniff.detect_line_ending(text) == expected


@pytest.mark.parametrize(("sample", "expected"), [(b"id,name\n1,2\n", True), (b"red,blue\ngreen,pink\n", False), (b"only,one,row\n", True), (b"name,age\nbob,3\n", True), (b"1,2\n3,4\n", False)])
def test_header(sample, expected):
    assert sniff.settings_of(sample).has_headers is expected


@pytest.mark.parametrize(("value", "expected"), [("1", True), (" 2.5 ", True), ("-1e5", True), (".5", True), ("5.", True), ("NaN", True), ("1d", False), ("", False), ("0x1", False), ("1_0", False)])
def test_numeric(value, expected):
    assert sniff.is_numeric(value) is expected


def test_encoding():
    assert sniff.detect_encoding("é".encode()) == "utf-8"
    assert sniff.detect_encoding("é€".encode("windows-1252")) == "windows-1252"
    assert sniff.detect_encoding("a".encode("utf-16")) == "utf-16le"
    assert sniff.detect_encoding(b"abc" + "é".encode()[:1]) == "utf-8"  # cut by the end of the sample
    # With the length of the file known, an incomplete character at its end is none.
    assert sniff.detect_encoding("Café".encode("windows-1252"), 4) == "windows-1252"
    assert sniff.detect_encoding("Café".encode()[:4], 5) == "utf-8"
    assert sniff.detect_encoding("Café".encode(), 5) == sniff.detect_encoding(b"", 0) == "utf-8"


def test_labels():
    settings = ParseSettings()
    labels = sniff.labels_of(b"id,id,,ID\n1,2,3,4\n", settings)
    assert labels == ["id", "id", "", "ID"]
    assert sniff.shown_labels(labels) == ["id", "id", "Column 3", "ID"]
    assert sniff.labels_of(b"1,2\n3\n", ParseSettings(has_headers=False)) == ["Column 1", "Column 2"]
    assert sniff.labels_of(b"\xef\xbb\xbfName,Value\n", settings) == ["Name", "Value"]


def test_estimate():
    assert sniff.estimated_rows(b"ab\ncd\n", 60, ParseSettings(line_ending="lf")) == 20
    assert sniff.estimated_rows(b"ab\rcd\r", 60, ParseSettings(line_ending="cr")) == 20
    assert sniff.estimated_rows(b"abc", 60, ParseSettings(line_ending="lf")) is None


def test_overrides():
    given = {"delimiter": "tab", "quote": "single", "escape": "backslash", "line_ending": "crlf", "encoding": "latin1", "has_headers": False, "malformed": "repair", "max_field_size": 10, "max_record_size": 20}
    assert with_overrides(ParseSettings(), given) == ParseSettings("\t", "'", "\\", "crlf", "windows-1252", False, "repair", 10, 20)
    assert with_overrides(ParseSettings(), {"delimiter": "long", "line_ending": "?"}) == ParseSettings()
    assert with_overrides(ParseSettings(), {"delimiter": "A"}).delimiter == "A"
    with pytest.raises(ValueError, match="malformed"):
        with_overrides(ParseSettings(), {"malformed": "whatever"})
    with pytest.raises(ValueError, match="settings"):
        with_overrides(ParseSettings(), {"colour": "red"})


def test_identity_covers_every_field():
    base = ParseSettings()
    others = [with_overrides(base, {k: v}) for k, v in (("delimiter", ";"), ("quote", "single"), ("escape", "backslash"), ("line_ending", "lf"), ("encoding", "latin1"), ("has_headers", False), ("malformed", "strict"), ("max_field_size", 1), ("max_record_size", 1))]
    assert len({s.identity() for s in [base, *others]}) == 10
