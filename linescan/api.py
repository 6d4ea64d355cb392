"""Entry points: searches of tables, directory trees and images, with sinks; and a table function for SQL."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from linescan.config import SearchConfig
from linescan.errors import InputMissing, NoPermission
from linescan.operators.ignore import Rule
from linescan.operators.search import search
from linescan.operators.stats import search_stats
from linescan.sources.directory import DirectoryTree
from linescan.sources.images import FilesystemImage

Inspect = Callable[[str, str | None, SearchConfig], None]


def tree(spark: SparkSession, root: str, config: SearchConfig, prune: bool = True) -> DataFrame:
    """The files of a directory tree, or one file."""
    spark.dataSource.register(DirectoryTree)
    return _loaded(spark, DirectoryTree.name(), root, config, prune).load()


def image(spark: SparkSession, path: str, config: SearchConfig, root: str = "/", prune: bool = True) -> DataFrame:
    """The files inside a filesystem image."""
    spark.dataSource.register(FilesystemImage)
    return _loaded(spark, FilesystemImage.name(), path, config, prune).option("root", root).load()


def _loaded(spark: SparkSession, name: str, path: str, config: SearchConfig, prune: bool):
    if not os.path.exists(path):  # planning happens in another process, whose errors arrive wrapped
        raise InputMissing(path)
    if not os.access(path, os.R_OK):
        raise NoPermission(path)
    reader = spark.read.format(name).option("path", path).option("all_dirs", str(not prune))
    if config.size_filter:
        reader = reader.option("max_bytes", str(config.max_file_bytes))
    return reader.option("no_ignore", str(not config.ignore_filter)).option("git_semantics", str(config.git_semantics))


class Searcher:
    """Runs searches one after another; a new one cancels what still runs."""

    def __init__(self, spark: SparkSession, inspect: Inspect | None = None):
        self.spark, self.inspect, self.tag = spark, inspect, f"linescan-{id(self)}"

    def files(self, config: SearchConfig, path: str | None = None, device: str | None = None) -> DataFrame:
        """Of a path, or of a path inside an image."""
        if self.inspect:
            self.inspect(path or "/", device, config)
        if device is not None:
            return image(self.spark, device, config, path or "/").where("error IS NULL")
        return tree(self.spark, path or ".", config).where("error IS NULL")

    def search(self, files: DataFrame, config: SearchConfig, rules: list[Rule] | None = None, skip: DataFrame | None = None) -> DataFrame:
        return search(files, config, rules, skip)

    def rows(self, found: DataFrame) -> Iterator[Row]:
        """Matches as they come, partition by partition; never all at once on the driver."""
        self.cancel()
        self.spark.addTag(self.tag)
        try:
            yield from found.toLocalIterator(prefetchPartitions=True)
        finally:
            self.spark.removeTag(self.tag)

    def each(self, found: DataFrame, call: Callable[[Row], None]) -> None:
        """Calls a function in the tasks for each match."""
        self.cancel()
        self.spark.addTag(self.tag)
        try:
            found.foreach(call)
        finally:
            self.spark.removeTag(self.tag)

    def stats(self, files: DataFrame, config: SearchConfig, rules: list[Rule] | None = None) -> DataFrame:
        return search_stats(files, config, rules)

    def cancel(self) -> None:
        self.spark.interruptTag(self.tag)


def register_grep(spark: SparkSession) -> None:
    """SELECT * FROM grep(text, pattern): line_num and line of the lines with a match of a regular expression.

    For SQL users; it runs in Python, line by line, so search() is faster wherever it can be used.
    """

    @F.udtf(returnType="line_num int, line string")
    class Grep:
        def eval(self, text: str | None, pattern: str | None):
            if text and pattern is not None:
                test = re.compile(pattern, re.ASCII)
                for i, line in enumerate(text.split("\n"), 1):
                    if test.search(line):
                        yield i, line

    spark.udtf.register("grep", Grep)
