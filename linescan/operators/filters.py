"""The filters of a search, in their order, as one status per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescan.config import SearchConfig
from linescan.functions.scalars import BINARY_EXTENSIONS, extension, file_name, is_binary, is_binary_text
from linescan.operators.ignore import Rule, common_dir, ignored, pruned

SEARCHED = "searched"
STATUSES = ("in_skipped_dir", "in_ignored_dir", "large", "binary_ext", "ignored", "by_index", "binary_probe", SEARCHED)


def size_of(files: DataFrame) -> Column:
    """The size column where there is one, else the bytes of the content."""
    return F.col("size") if "size" in files.columns else F.coalesce(F.octet_length(F.col("text")).cast("bigint"), F.lit(0))


def _probe(files: DataFrame) -> Column:
    return is_binary_text(F.col("text")) if dict(files.dtypes)["text"] == "string" else is_binary(F.col("text"))


def content(files: DataFrame) -> Column:
    return F.col("text").cast("binary") if dict(files.dtypes)["text"] == "string" else F.col("text")


def with_status(files: DataFrame, config: SearchConfig, rules: list[Rule] | None = None, skip: DataFrame | None = None, root: str = "") -> DataFrame:
    """files(path, text and possibly size) with a column status, the first filter that holds, or searched.

    rules apply to paths relative to root. skip(path) names the files that an index rules out. The content is looked at
    last, so that it isn't read for files that a cheaper filter drops.
    """
    path = F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path")) if root else F.col("path")
    name = file_name(F.col("path"))
    ext = name if config.compat_ext else extension(name)
    never = F.lit(False)
    by_rules = list(rules or []) if config.ignore_filter else []
    if skip is not None:
        files = files.join(skip.select("path").distinct().withColumn("by_index", F.lit(True)), "path", "left")
    status = (
        F.when(common_dir(path), "in_skipped_dir")
        .when(pruned(by_rules, path), "in_ignored_dir")
        .when(size_of(files) > config.max_file_bytes if config.size_filter else never, "large")
        .when(ext.isin(*BINARY_EXTENSIONS) if config.binary_filter else never, "binary_ext")
        .when(ignored(by_rules, path, False, name), "ignored")
        .when(F.col("by_index").isNotNull() if skip is not None else never, "by_index")
        .when(_probe(files) if config.binary_filter else never, "binary_probe")
        .otherwise(SEARCHED)
    )
    out = files.withColumn("status", status)
    return out.drop("by_index") if skip is not None else out
