import pytest

from linescan.config import SearchConfig
from linescan.operators import filters, output, stats
from linescan.operators.ignore import parse_rules
from linescan.operators.search import files_without_matches, lines, search

BASE = SearchConfig("x")


def status(spark, name, content, config=BASE, size=None, rules=None):
    row = (name, bytearray(content), len(content) if size is None else size)
    df = spark.createDataFrame([row], "path string, text binary, size long")
    return filters.with_status(df, config, rules).first().status


@pytest.mark.parametrize(
    "name,content,config,size,want",
    [
        ("a", b"x", BASE, 8388608, "searched"),
        ("a", b"x", BASE, 8388609, "large"),
        ("a", b"x", BASE.with_flags(unrestricted=1), 8388609, "searched"),
        ("a", b"x", BASE.with_flags(large=True), 8388609, "searched"),
        ("x.png", b"x", BASE, None, "binary_ext"),
        ("x.png", b"x", SearchConfig("x", compat_ext=True), None, "searched"),
        ("png", b"x", SearchConfig("x", compat_ext=True), None, "binary_ext"),
        ("png", b"x", BASE, None, "searched"),
        ("a", b"a" * 4095 + b"\0" + b"a" * 904, BASE, None, "binary_probe"),
        ("a", b"a" * 4096 + b"\0" + b"a" * 903, BASE, None, "searched"),
        ("a", b"\1" * 51, BASE, None, "searched"),
        ("a", b"\1" * 52, BASE, None, "binary_probe"),
        ("a", b"\x7f" * 64, BASE, None, "binary_probe"),
        ("a", b"\xc3" * 64, BASE, None, "searched"),
        ("a", b"\1" * 52, BASE.with_flags(binary=True), None, "searched"),
        ("a", b"", BASE, None, "searched"),
        ("src/target/a", b"x", BASE.with_flags(everything=True), None, "in_skipped_dir"),
        (".hidden.txt", b"x", BASE, None, "searched"),
    ],
)
def test_status(spark, name, content, config, size, want):
    assert status(spark, name, content, config, size) == want


def test_flags():
    on = lambda c: (c.size_filter, c.ignore_filter, c.binary_filter)
    assert on(BASE) == (True, True, True)
    assert on(BASE.with_flags(1)) == on(BASE.with_flags(2)) == (False, False, True)
    assert on(BASE.with_flags(3)) == on(BASE.with_flags(everything=True)) == (False, False, False)
    assert on(BASE.with_flags(large=True)) == (False, True, True)
    assert on(BASE.with_flags(no_ignore=True)) == (True, False, True)
    assert on(BASE.with_flags(binary=True)) == (True, True, False)
    with pytest.raises(ValueError):
        BASE.with_flags(1, large=True)


def test_lines(spark):
    df = spark.createDataFrame([("a", "x\n\ny\r\n"), ("b", ""), ("c", None), ("d", "z")], "path string, text string")
    assert [tuple(r) for r in lines(df).collect()] == [("a", 1, "x"), ("a", 2, ""), ("a", 3, "y\r"), ("a", 4, ""), ("d", 1, "z")]


def test_invalid_utf8_is_searched(spark):
    df = spark.createDataFrame([("a", bytearray(b"\xff\xfe needle\nno"))], "path string, text binary")
    assert [r.line_num for r in search(df, SearchConfig("needle")).collect()] == [1]


def test_stats_add_up(spark):
    rows = [("a.txt", "x"), ("b.png", "x"), ("c.txt", "y\0"), ("d.txt", "x" * 50), ("skip.me", "x"), ("no/e", "x"), ("target/f", "x"), ("deep/no/g", "y"), ("h/i/j", "y")]
    df = spark.createDataFrame(rows, "path string, text string")
    rules = parse_rules("*.me\n**/no/\n")
    config = SearchConfig("x", max_file_bytes=40)
    s = stats.search_stats(df, config, rules).first().asDict()
    assert s["files_encountered"] == 6 == sum(v for k, v in s.items() if k.startswith("files_skipped")) + s["files_searched"]
    assert (s["files_searched"], s["files_contained_matches"], s["bytes_searched"]) == (2, 1, 2)
    assert (s["dirs_encountered"], s["dirs_skipped_common"], s["dirs_skipped_gitignore"]) == (4, 1, 2)
    assert set(s) == set(stats.COUNTERS)
    assert stats.stats_report(stats.search_stats(df, config, rules)).count() == 17
    empty = stats.search_stats(df.limit(0), config, rules).first()
    assert empty.files_encountered == 0 and empty.bytes_searched == 0 and empty.dirs_encountered == 1


def test_files_without_matches(spark):
    df = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None), ("d", "y")], "path string, text string")
    assert sorted(r.path for r in files_without_matches(df, BASE).collect()) == ["b", "c", "d"]


def test_formats(spark):
    df = spark.createDataFrame([("a/b", "é x\nx x\nno")], "path string, text string")
    found = search(df, BASE)
    assert [r.formatted for r in output.match_lines(found, "r").collect()] == ["r/a/b:1: é x", "r/a/b:2: x x"]
    assert [r.formatted for r in output.with_headers(found).orderBy("line_num").collect()] == ["a/b:\n1: é x", "2: x x"]
    red = f"{output.RED}x{output.RESET}"
    shown = [r.formatted for r in output.match_lines(found, jump=False, color=True).collect()]
    assert shown == [f"{output.CYAN}1{output.RESET}: é {red}", f"{output.CYAN}2{output.RESET}: {red} {red}"]
    cut = output.match_lines(found, jump=False, color=True, most=2).collect()
    assert cut[0].formatted.endswith(": é") and cut[1].formatted.endswith(f": {red} ")
