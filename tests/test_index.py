import random

import pytest

from linescan.config import SearchConfig
from linescan.functions.pattern import compile_pattern
from linescan.operators import index
from linescan.operators.search import search


def frame(spark, files, mtime=0):
    return spark.createDataFrame([(p, t, mtime) for p, t in files.items()], "path string, text string, mtime long")


class Searches:
    """Searches in turn, each with the index that those before have left."""

    def __init__(self, spark):
        self.spark, self.index = spark, spark.createDataFrame([], index.SCHEMA)

    def run(self, files, pattern, mtime=0):
        df, compiled = frame(self.spark, files, mtime), compile_pattern(pattern)
        skip = index.skippable(self.index, df, compiled)
        with_index = {(r.path, r.line_num) for r in search(df, SearchConfig(pattern), skip=skip).collect()}
        without = {(r.path, r.line_num) for r in search(df, SearchConfig(pattern)).collect()}
        assert with_index == without
        new = index.build(df, index.pattern_grams(compiled))
        rows = index.upserted(self.index, new).collect()
        self.index = self.spark.createDataFrame(rows, index.SCHEMA)
        return {p for p, _ in with_index}, skip.count()


def test_files_that_come_later_are_found(spark):
    s = Searches(spark)
    s.run({"x": "needle1"}, "foobar")
    s.run({"x": "needle1", "y": "foobar"}, "needle1")
    assert s.run({"x": "needle1", "y": "foobar"}, "foobar") == ({"y"}, 1)


def test_changed_files_are_found(spark):
    s = Searches(spark)
    s.run({"x": "abc"}, "foobar", 1)
    s.run({"x": "foobar"}, "needle1", 2)
    assert s.run({"x": "foobar"}, "foobar", 2)[0] == {"x"}


def test_alternatives_and_optional_parts(spark):
    s = Searches(spark)
    s.run({"x": "needle1 color"}, "foobar")
    assert s.run({"x": "needle1 color"}, "foobar|needle1")[0] == {"x"}
    s.run({"x": "needle1 color"}, "colour")
    assert s.run({"x": "needle1 color"}, "colou?r")[0] == {"x"}


def test_index_never_changes_a_result(spark):
    rng = random.Random(5)
    s, files = Searches(spark), {f"f{i}": "".join(rng.choices("ab", k=rng.randint(0, 12))) for i in range(12)}
    for step in range(8):
        for name in rng.sample(sorted(files), 3):
            files[name] = "".join(rng.choices("ab", k=rng.randint(0, 12)))
        pattern = rng.choice(["", "|", "x?"]).join("".join(rng.choices("ab", k=rng.randint(4, 6))) for _ in range(2))
        s.run(files, pattern, step)


@pytest.mark.parametrize(
    "have,pattern,want",
    [("aaaa", "aaaabbbb", True), ("aaaa", "aaaa", False), ("aaaabbbb", "aaaa|bbbb", False), ("cccc", "aaaa|bbbb", True), ("cccc", "aaa", False), ("aaaa", "aaaa.*bbbb", True)],
)
def test_skip(spark, have, pattern, want):
    df, compiled = frame(spark, {"f": have}), compile_pattern(pattern)
    built = index.build(df, index.pattern_grams(compiled))
    assert (index.skippable(built, df, compiled).count() == 1) == want
    other = frame(spark, {"f": have + "z"})
    assert index.skippable(built, other, compiled).count() == 0
    assert index.skippable(built, frame(spark, {"g": have}), compiled).count() == 0


def test_save_and_load(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    assert index.load(spark, folder).count() == 0
    built = index.build(frame(spark, {"f": "hello world", "g": None}), index.pattern_grams(compile_pattern("hello")))
    index.save(built, folder)
    assert {(r.path, r.present) for r in index.load(spark, folder).collect()} == {("f", True), ("g", False)}
    index.save(index.upserted(index.load(spark, folder), built), folder)
    assert index.load(spark, folder).count() == 4
    assert index.load(spark, folder, rebuild=True).count() == 0


def test_fragments():
    assert [len(compile_pattern(p).fragments()[0]) for p in ("hello", "aaaa", "hi")] == [2, 1, 0]
    assert compile_pattern("hello|foobar").fragments() == [[b"ello", b"hell"], [b"foob", b"obar", b"ooba"]]
