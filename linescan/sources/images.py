"""Filesystem images as a Spark data source: files are found and read inside the image, which isn't mounted.

    spark.dataSource.register(FilesystemImage)
    spark.read.format("linescan_image").option("path", image).option("root", "/src").load()

The driver finds which filesystem it is and walks its directories; tasks read the contents by ranges of the image.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linescan.errors import BrokenImage, InputMissing, UnknownFilesystem
from linescan.functions.scalars import SKIPPED_DIRS
from linescan.operators.ignore import Rule, parse_rules
from linescan.sources.directory import SCHEMA, is_ignored

PARTITION_BYTES = 32 << 20
FILE, DIR, OTHER = "file", "dir", "other"


@dataclass(frozen=True)
class Node:
    file_id: int
    kind: str
    size: int
    mtime: int


class Filesystem(Protocol):
    """What a filesystem that can be searched offers."""

    root_id: int

    def node(self, file_id: int) -> Node: ...

    def entries(self, file_id: int) -> list[tuple[str, int]]: ...

    def ranges(self, file_id: int) -> list[tuple[int | None, int]]:
        """(offset in the image or None for a hole, length) of the whole content, in order."""

    def content(self, file_id: int, most: int | None = None) -> bytes: ...


class Image:
    """Random access to an image file."""

    def __init__(self, path: str):
        try:
            self.file = open(path, "rb")  # noqa: SIM115
        except FileNotFoundError as bad:
            raise InputMissing(path) from bad

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) < length:
            raise BrokenImage(f"the image ends before {offset + length}")
        return data

    def close(self) -> None:
        self.file.close()


def detect(head: bytes) -> str | None:
    """ntfs, apfs or ext4 by magic numbers in the first 2 KiB."""
    if head[3:11] == b"NTFS    ":
        return "ntfs"
    if head[32:36] == b"NXSB":
        return "apfs"
    if head[1080:1082] == b"\x53\xef":
        return "ext4"
    return None


def opened(path: str) -> tuple[Image, Filesystem]:
    from linescan.sources.ext4 import Ext4
    from linescan.sources.ntfs import Ntfs

    image = Image(path)
    image.file.seek(0)
    kind = detect(image.file.read(2048))
    if kind == "ext4":
        return image, Ext4(image)
    if kind == "ntfs":
        return image, Ntfs(image)
    image.close()
    raise UnknownFilesystem(f"{path}: {'APFS can be told, but not read' if kind else 'no known magic number'}")


def resolve(fs: Filesystem, path: str) -> int:
    """The id of a path within the image."""
    at = fs.root_id
    for part in path.split("/"):
        if part and part != ".":
            at = next((i for name, i in fs.entries(at) if name == part), 0)
            if not at:
                raise InputMissing(path)
    return at


def walk(fs: Filesystem, root: str = "/", ignore: bool = True, git_semantics: bool = False, prune: bool = True) -> Iterator[tuple[str, Node | None]]:
    """Path below root, and node, of every regular file that no rule excludes; None for nodes that can't be read."""
    start = fs.node(resolve(fs, root))
    if start.kind == FILE:
        yield root.rstrip("/").rpartition("/")[2], start
        return
    todo: list[tuple[str, int, list[Rule]]] = [("", start.file_id, [])]
    while todo:
        path, dir_id, rules = todo.pop()
        try:
            entries = [e for e in fs.entries(dir_id) if e[0] not in (".", "..")]
        except (BrokenImage, ValueError, IndexError):
            continue
        rule_file = next((i for name, i in entries if name == ".gitignore"), None)
        if ignore and rule_file is not None:
            rules = rules + parse_rules(fs.content(rule_file).decode("utf-8", "replace"), path, git_semantics)
        for name, file_id in entries:
            own = f"{path}/{name}" if path else name
            try:
                node = fs.node(file_id)
            except (BrokenImage, ValueError, IndexError):
                yield own, None
                continue
            if node.kind == DIR:
                if not (prune and name in SKIPPED_DIRS) and not is_ignored(rules, own, True):
                    todo.append((own, file_id, rules))
            elif node.kind == FILE and not is_ignored(rules, own, False):
                yield own, node


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        on = lambda name: self.options.get(name, "false").lower() == "true"
        most = int(self.options.get("partition_bytes", PARTITION_BYTES))
        image, fs = opened(self.options["path"])
        out: list[InputPartition] = []
        part: list[tuple[str, int]] = []
        size = 0
        for path, node in walk(fs, self.options.get("root", "/"), not on("no_ignore"), on("git_semantics"), not on("all_dirs")):
            part.append((path, node.file_id if node else 0))
            size += node.size if node else 0
            if size >= most:
                out.append(_Files(part))
                part, size = [], 0
        image.close()
        return [*out, _Files(part)] if part or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:  # type: ignore[override]
        image, fs = opened(self.options["path"])
        limit = self.options.get("max_bytes")
        for path, file_id in partition.files:
            try:
                node = fs.node(file_id)
                content = fs.content(file_id) if limit is None or node.size <= int(limit) else None
                yield path, 0, file_id, node.size, node.mtime, content, None
            except (BrokenImage, ValueError, IndexError) as bad:
                yield path, 0, file_id, None, None, None, f"{type(bad).__name__}: {bad}"
        image.close()


class FilesystemImage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linescan_image"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise InputMissing("option path")
        return _Reader(dict(self.options))
