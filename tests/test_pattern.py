import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linescan.config import SearchConfig
from linescan.errors import PatternError
from linescan.functions import scalars
from linescan.functions.pattern import compile_pattern, grams, java_regex, literal_part, mandatory_runs
from linescan.operators import index
from linescan.operators.search import files_without_matches, search

CASES = [
    ("TODO", {}, "a TODO b\nTODO TODO\n", [(1, 2, 6), (2, 0, 4), (2, 5, 9)]),
    ("aa", {}, "aaaa", [(1, 0, 2), (1, 2, 4)]),
    ("b", {}, "aéb", [(1, 3, 4)]),
    ("^foo$", {}, "xfooy", [(1, 1, 4)]),
    ("a.b", {"force_literal": True}, "axb a.b", [(1, 4, 7)]),
    ("foo|foobar", {}, "foobar", [(1, 0, 3)]),
    ("foobar|foo", {}, "foobar", [(1, 0, 6)]),
    ("(foo|bar)", {}, "foo", [(1, 0, 3)]),
    ("(foo|bar)", {"compat_alternation": True}, "foo", []),
    ("foo|ba.r", {}, "baxr", [(1, 0, 4)]),
    ("foo|ba.r", {"compat_alternation": True}, "baxr", []),
    ("[a]b$", {}, "ab\r\n", []),
    ("a*", {}, "b\n", [(1, 0, 0), (1, 1, 1), (2, 0, 0)]),
    ("a*", {}, "ab", [(1, 0, 1), (1, 2, 2)]),
    ("foo|", {}, "xfoo", [(1, 0, 0), (1, 1, 4)]),
    ("x", {}, "", []),
    ("", {}, "ab\n", [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 0)]),
    ("日本", {}, "x日本y日本", [(1, 1, 7), (1, 8, 14)]),
    ("a\nb", {"force_literal": True}, "a\nb", []),
    ("[[:digit:]]+", {}, "ab12", [(1, 2, 4)]),
    ("b", {}, "﷐b﷑b", [(1, 3, 4), (1, 7, 8)]),
]


@pytest.mark.parametrize("pattern,options,text,expected", CASES)
def test_spans(spark, pattern, options, text, expected):
    files = spark.createDataFrame([("f", text)], "path string, text string")
    found = search(files, SearchConfig(pattern, binary_filter=False, **options)).collect()
    assert [(r.line_num, x.start, x.end) for r in found for x in r.ranges] == expected


def test_null_text_has_no_lines(spark):
    files = spark.createDataFrame([("f", None), ("g", "a")], "path string, text string")
    assert [r.path for r in search(files, SearchConfig("")).collect()] == ["g"]


def test_spans_equal_python(spark):
    texts = ["the other then", "aaa bab", "ééthé the", "", "x" * 2000 + "the"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    for pattern in ("the", "[ab]+", "t.e|ab", "é"):
        got = {(r.path, x.start, x.end) for r in search(files, SearchConfig(pattern)).collect() for x in r.ranges}
        want = {(str(i), len(t[: m.start()].encode()), len(t[: m.end()].encode())) for i, t in enumerate(texts) for m in re.finditer(pattern, t)}
        assert got == want


def test_kinds():
    assert compile_pattern("foo").kind == "literal"
    assert compile_pattern("foo|bar").kind == "literals"
    assert compile_pattern("fo+").kind == "regex"
    assert literal_part("^^foo$$") == "foo" and literal_part("f.o") is None


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?=a)", "(?<!a)b", "a++", "(", "[a", "a{2}+", "(?>a)", r"\k<n>", "a?+b"])
def test_refused(spark, pattern):
    with pytest.raises(PatternError):
        compile_pattern(pattern)


ATOMS = [
    ("a", "a"), ("b", "b"), ("4", "4"), ("1", "1"), ("c", "c"), ("é", "é"), ("😀", "😀"), (r"\.", "."), (r"\]", "]"), (r"\_", "_"), (r"\-", "-"),
    (r"\x41", "A"), (r"\x{1F600}", "😀"), (r"\u0042", "B"), (r"\d", "7"), (r"\w", "k"), (r"\S", "z"), (r"\W", "!"), (r"\p{Alpha}", "q"), (r"\pL", "L"),
    (r"\P{Alpha}", "3"), (r"\t", "\t"), (r"\e", "\x1b"), (r"\cA", "\x01"), (r"\07", "\x07"), (r"\053", "+"), (".", "x"), ("[abc]", "b"), (r"[\]abcd]", "]"), ("[^abc]", "d"),
    ("[a[b]cdef]", "e"), ("[a-z&&[def]]", "f"), (r"[\x41-\x43]", "B"), ("[[:digit:]]", "5"), (r"[\[]", "["), ("(ab4)", "ab4"), ("(a(b)c)", "abc"), ("(a|1c)", "1c"),
    (r"\Qa.b\E", "a.b"), (r"\b", ""), ("(?:b4)", "b4"), ("[{}]", "{"), (r"\{", "{"),
]
REPEATS = [("", 1, 1), ("*", 0, 2), ("?", 0, 1), ("+", 1, 3), ("{2}", 2, 2), ("{0}", 0, 0), ("{1,3}", 1, 3), ("{0,}", 0, 2), ("*?", 0, 2), ("+?", 1, 2), ("??", 0, 1), ("{2,}?", 2, 3)]


def test_mandatory_runs_of_escapes_and_classes(spark):
    """Patterns and texts that they match, from one grammar, with Java as the judge of what matches."""
    rng, compile_ = random.Random(7), spark.sparkContext._jvm.java.util.regex.Pattern.compile
    matched = said = 0
    for _ in range(3000):
        pattern = text = ""
        for _ in range(rng.randint(1, 7)):
            (atom, one), (repeat, least, most) = rng.choice(ATOMS), rng.choice(REPEATS) if rng.random() < 0.4 else REPEATS[0]
            if atom == r"\b":
                repeat = ""
            pattern, text = pattern + atom + repeat, text + one * rng.randint(least, most)
        java = java_regex(pattern)
        if compile_(java).matcher(text).find():
            runs = mandatory_runs(pattern)
            matched, said = matched + 1, said + bool(runs)
            assert all(run in text for run in runs), (pattern, text, runs)
    assert matched > 2000 and said > 700


@pytest.mark.parametrize(
    "pattern,text,n",
    [(r"\x41bc", "see Abc here", 1), (r"\x54ODO", "TODO now", 1), (r"[\]abcd]x", "x ]x y", 1), (r"\u0041bcd", "Abcd", 1), ("[a[b]cdef]gh", "egh", 1), (r"\053x1", "+x1", 1)],
)
def test_escapes_lose_no_match(spark, pattern, text, n):
    files = spark.createDataFrame([("f", text)], "path string, text string")
    assert search(files, SearchConfig(pattern)).count() == n == files.where(F.col("text").rlike(java_regex(pattern))).count()
    assert files_without_matches(files, SearchConfig(pattern)).count() == 0
    index_rows = index.build(files, index.pattern_grams(compile_pattern(pattern)))
    assert index.skippable(index_rows, files, compile_pattern(pattern)).count() == 0


@pytest.mark.parametrize("pattern", ["[*+]a", r"\x{41}+", r"\}+", r"\++", "[+]+", r"\\+", r"\Qa++\E+", "a+?", "[^]+*]+"])
def test_not_refused(spark, pattern):
    assert compile_pattern(pattern).kind == "regex"


def test_mandatory_runs():
    assert mandatory_runs("colou?r") == ("colo", "r")
    assert mandatory_runs("ab+c") == ("ab", "c")
    assert mandatory_runs("a{0}bc") == ("bc",)
    assert mandatory_runs("(abc)def") == ("def",)
    assert mandatory_runs(r"x\.y\d") == ("x.y",)
    assert mandatory_runs("a|b") == ()


@settings(max_examples=300, deadline=None)
@given(st.text("ab.*+?[]()|\\x", max_size=8), st.text("abx", max_size=10))
def test_mandatory_runs_are_in_every_match(pattern, text):
    try:
        test = re.compile(pattern)
    except re.error:
        return
    if test.search(text):
        assert all(run in text for run in mandatory_runs(pattern))


def test_grams(spark):
    assert grams("hello") == [b"hell", b"ello"] and grams("aaaa") == [b"aaaa"] and grams("hi") == []
    row = spark.range(1).select(scalars.gram_hash(F.lit(b"test")).alias("a"), scalars.gram_hash(F.lit(b"TODO")).alias("b")).first()
    assert (row.a, row.b) == (373564628, 1961363380)


def test_scalars(spark):
    rows = spark.createDataFrame([(n,) for n in (1023, 1024, 1048576, 1073741824, 1152)], "n long")
    assert [r[0] for r in rows.select(scalars.format_bytes(F.col("n"))).collect()] == ["1023 B", "1.00 KB", "1.00 MB", "1.00 GB", "1.12 KB"]
    paths = spark.createDataFrame([(p,) for p in ("/usr/bin", "/usr", "/", "foo/bar", "foo", "/usr/bin/", "")], "p string")
    got = paths.select(scalars.path_parent(F.col("p")), scalars.file_name(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("/usr", "bin"), ("/", "usr"), ("", "/"), ("foo", "bar"), ("", "foo"), ("/usr", "bin"), ("", "")]
    texts = spark.createDataFrame([("a" * 499 + "é",), ("a" * 498 + "é",), ("a" * 600,), ("日" * 200,), ("a" * 498 + "😀",)], "t string")
    cut = [r[0] for r in texts.select(scalars.truncated(F.col("t"), 500)).collect()]
    assert cut == ["a" * 499, "a" * 498 + "é", "a" * 500, "日" * 166, "a" * 498]
    strides = spark.createDataFrame([(n,) for n in (65536, 65537, 1048576, 1048577)], "n long")
    assert [r[0] for r in strides.select(scalars.stride(F.col("n"))).collect()] == [1, 8, 8, 64]
    assert spark.range(1).select(scalars.filetime_to_unix(F.lit(116444736010000000))).first()[0] == 1
