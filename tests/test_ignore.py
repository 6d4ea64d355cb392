import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linescan.operators import ignore
from linescan.sources.directory import is_ignored

DEEP = ("target/\n*.log\n.env\nnode_modules/", "generated/\n*.generated.rs", "fixtures/\n*.snapshot\n!important.snapshot")
#: rule files by depth, ignored, not ignored; a slash at the end marks a directory
GOLDEN = [
    ([], "", "anything file.txt node_modules/"),
    ([(0, "*.log\ntarget/")], "test.log target/", "file.txt"),
    ([(0, "node_modules\n*.tmp")], "node_modules/ src/node_modules/ file.tmp deep/path/file.tmp", ""),
    ([(0, "*.log"), (1, "*.tmp")], "test.log test.tmp", "test.txt"),
    ([(0, "*.log"), (1, "*.tmp"), (2, "*.bak")], "test.log test.tmp test.bak", "test.txt"),
    ([(0, "*.log"), (1, "*.tmp"), (1, "*.bak")], "test.log test.bak test.tmp", ""),
    ([(0, "*.log\n!important.log")], "test.log debug.log", "important.log"),
    ([(0, "*.log"), (1, "!important.log")], "test.log debug.log", "important.log"),
    ([(0, "*.log"), (1, "!important.log"), (2, "important.log")], "important.log", ""),
    ([(0, "*.txt"), (1, "!readme.txt\n*.md")], "test.txt doc.md", "readme.txt"),
    (list(enumerate(DEEP)), "target/ app.log .env node_modules/ generated/ types.generated.rs fixtures/ test.snapshot", "important.snapshot main.rs Cargo.toml"),
    ([(0, ".git/\n*.log\n.env*"), (2, "dist/\nnode_modules/\n.next/")], "dist/ node_modules/ .next/ .git/ debug.log", "target/"),
    ([(0, ".git/\n*.log\n.env*"), (2, "target/\n*.pyc\n__pycache__/")], "target/ app.pyc __pycache__/ .git/ debug.log", "node_modules/"),
    ([(0, "")], "", "anything"),
    ([(0, "# Just a comment\n# Another comment")], "", "file.txt"),
    ([(0, "secret.txt")], "secret.txt a/secret.txt a/b/c/d/e/secret.txt", ""),
    ([(0, "build/\nbuild.rs")], "build/ build.rs src/build.rs", "build"),
    ([(0, "日本語.txt\n*.中文")], "日本語.txt test.中文", ""),
    ([(0, "\n".join(f"file{i}.txt" for i in range(300)))], "file0.txt file250.txt", "file500.txt"),
    ([(0, "target")], "a/b/c/d/target/", ""),
    ([(0, "target2/")], "target2/", "a/target2/"),
    ([(0, "/*.log")], "a/b.log b.log", "b.txt"),
    ([(0, "[a-c]x\n[!a-c]y\nq[")], "ax cx dy", "dx ay q["),
    ([(0, "  *.log  \n!\n/\n")], "a.log", "a"),
]


def rules_of(files):
    return [r for depth, text in sorted(files, key=lambda f: f[0]) for r in ignore.parse_rules(text)]


@pytest.mark.parametrize("files,out,kept", GOLDEN)
def test_golden(spark, files, out, kept):
    rules = rules_of(files)
    rows = [(p.rstrip("/"), p.endswith("/"), want) for text, want in ((out, True), (kept, False)) for p in text.split()]
    df = spark.createDataFrame(rows, "path string, is_dir boolean, want boolean")
    wrong = df.where(ignore.ignored(rules, F.col("path"), F.col("is_dir")) != F.col("want")).collect()
    assert wrong == []
    assert all(is_ignored(rules, p, d) == want for p, d, want in rows)


def test_names_with_blanks(spark):
    rules = ignore.parse_rules("file with spaces.txt\nfile-with-dashes.log")
    assert is_ignored(rules, "a/file with spaces.txt", False) and is_ignored(rules, "file-with-dashes.log", False)


def test_nested_rules_and_git_semantics(spark):
    files = [("", "*.log\n"), ("sub", "/x\n!keep.log\n")]
    ours, git = ignore.chain(files), ignore.chain(files, git_semantics=True)
    assert not is_ignored(ours, "sub/x", False) and is_ignored(git, "sub/x", False)
    assert is_ignored(ours, "a.log", False) and not is_ignored(ours, "sub/keep.log", False) and is_ignored(ours, "keep.log", False)
    assert is_ignored(ignore.parse_rules("t/", "", True), "a/t", True)


def test_pruned_directory_keeps_its_files(spark):
    rules = ignore.parse_rules("gone/\n!gone/a.txt")
    df = spark.createDataFrame([("gone/a.txt",), ("gone/b/c.txt",), ("here/a.txt",), ("a",)], "path string")
    assert [r[0] for r in df.select(ignore.pruned(rules, F.col("path"))).collect()] == [True, True, False, False]


def test_common_dirs(spark):
    df = spark.createDataFrame([("src/target/a",), ("target",), ("a/.cache/b/c",), ("targets/a",)], "path string")
    assert [r[0] for r in df.select(ignore.common_dir(F.col("path"))).collect()] == [True, False, True, False]


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?", max_size=6), st.text("ab/", max_size=8))
def test_glob(pattern, text):
    def glob(p, t):
        if not p:
            return not t
        if p[0] == "*":
            return any(glob(p[1:], t[i:]) for i in range(len(t) + 1))
        return bool(t) and (p[0] == "?" or p[0] == t[0]) and glob(p[1:], t[1:])

    assert (re.match(ignore.glob_regex(pattern).replace(r"\z", r"\Z"), text) is not None) == glob(pattern, text)
