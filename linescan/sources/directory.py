"""Directory trees as a Spark data source: every regular file, hidden ones too.

    spark.dataSource.register(DirectoryTree)
    spark.read.format("linescan_tree").option("path", root).load()

The driver lists the tree, prunes always-skipped directories and what ignore files exclude, and plans partitions of
about chunk bytes; the tasks read the contents. Options: path (file or directory), all_dirs (no pruning by name),
no_ignore, max_bytes (larger files come without content), git_semantics, partition_bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linescan.errors import InputMissing, NoPermission
from linescan.functions.scalars import SKIPPED_DIRS
from linescan.operators.ignore import Rule, glob_regex, parse_rules

SCHEMA = "path string, device_id bigint, file_id bigint, size bigint, mtime bigint, text binary, error string"
PARTITION_BYTES = 32 << 20


def _matches(rule: Rule, path: str, is_dir: bool) -> bool:
    if (rule.dir_only and not is_dir) or (rule.dir and not path.startswith(rule.dir + "/")):
        return False
    target = path if rule.anchored else path.rpartition("/")[2]
    if not set(rule.pattern) & set("*?["):
        return target == rule.pattern or (rule.anchored and path.startswith(rule.pattern + "/"))
    return re.match(glob_regex(rule.pattern).replace(r"\z", r"\Z"), target) is not None


def is_ignored(rules: list[Rule], path: str, is_dir: bool) -> bool:
    """The last matching rule decides; for one path, on the driver."""
    for rule in reversed(rules):
        if _matches(rule, path, is_dir):
            return not rule.negated
    return False


@dataclass
class Listing:
    files: list[tuple[str, str]]  # path relative to the root, full path
    dirs: int = 0
    dirs_skipped_common: int = 0
    dirs_skipped_ignored: int = 0
    files_ignored: int = 0
    unreadable: int = 0


def walk(root: str, ignore: bool = True, git_semantics: bool = False, prune: bool = True) -> Listing:
    """The regular files below root, or root itself; links are not followed."""
    if not os.path.exists(root):
        raise InputMissing(root)
    if not os.path.isdir(root):
        return Listing([(os.path.basename(root), root)])
    found = Listing([])
    todo: list[tuple[str, str, list[Rule]]] = [(root, "", [])]
    while todo:
        full, path, rules = todo.pop()
        try:
            entries = sorted(os.scandir(full), key=lambda e: e.name)
        except PermissionError as bad:
            if not path:
                raise NoPermission(root) from bad
            found.unreadable += 1
            continue
        found.dirs += 1
        if ignore and any(e.name == ".gitignore" and e.is_file(follow_symlinks=False) for e in entries):
            with open(os.path.join(full, ".gitignore"), encoding="utf-8", errors="surrogateescape") as text:
                rules = rules + parse_rules(text.read(), path, git_semantics)
        for e in entries:
            own = f"{path}/{e.name}" if path else e.name
            if e.is_dir(follow_symlinks=False):
                if prune and e.name in SKIPPED_DIRS:
                    found.dirs_skipped_common += 1
                elif is_ignored(rules, own, True):
                    found.dirs_skipped_ignored += 1
                else:
                    todo.append((e.path, own, rules))
            elif e.is_file(follow_symlinks=False):
                if is_ignored(rules, own, False):
                    found.files_ignored += 1
                else:
                    found.files.append((own, e.path))
    return found


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, str]]
    max_bytes: int | None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        on = lambda name: self.options.get(name, "false").lower() == "true"
        limit = self.options.get("max_bytes")
        most = int(self.options.get("partition_bytes", PARTITION_BYTES))
        out: list[InputPartition] = []
        part: list[tuple[str, str]] = []
        size = 0
        for path, full in walk(self.options["path"], not on("no_ignore"), on("git_semantics"), not on("all_dirs")).files:
            part.append((path, full))
            try:
                size += os.lstat(full).st_size
            except OSError:
                pass
            if size >= most or len(part) >= 10_000:
                out.append(_Files(part, int(limit) if limit else None))
                part, size = [], 0
        if part or not out:
            out.append(_Files(part, int(limit) if limit else None))
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:  # type: ignore[override]
        for path, full in partition.files:
            shown = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            try:
                at = os.lstat(full)
                content = None
                if partition.max_bytes is None or at.st_size <= partition.max_bytes:
                    with open(full, "rb") as file:
                        content = file.read()
                yield shown, at.st_dev, at.st_ino, at.st_size, int(at.st_mtime), content, None
            except OSError as bad:  # one file that can't be read doesn't end the search
                yield shown, None, None, None, None, None, f"{type(bad).__name__}: {bad.strerror}"


class DirectoryTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linescan_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise InputMissing("option path")
        return _Reader(dict(self.options))
