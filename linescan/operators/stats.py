"""Counters of a search, as a relation of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescan.config import SearchConfig
from linescan.functions.scalars import format_bytes
from linescan.operators.filters import SEARCHED, size_of, with_status
from linescan.operators.ignore import Rule, directories
from linescan.operators.search import as_text, compiled

COUNTERS = (
    "files_encountered", "files_searched", "files_contained_matches", "files_skipped_large", "files_skipped_as_binary_due_to_ext",
    "files_skipped_as_binary_due_to_probe", "files_skipped_unreadable", "files_skipped_gitignore", "files_skipped_by_cache",
    "symlinks_followed", "symlinks_broken", "bytes_searched", "dirs_encountered", "dirs_skipped_common", "dirs_skipped_gitignore",
)


def status_breakdown(files: DataFrame, config: SearchConfig, rules: list[Rule] | None = None) -> DataFrame:
    """Files and bytes by status."""
    return with_status(files, config, rules).groupBy("status").agg(F.count("*").alias("n_files"), F.sum(size_of(files)).alias("n_bytes"))


def search_stats(files: DataFrame, config: SearchConfig, rules: list[Rule] | None = None, skip: DataFrame | None = None) -> DataFrame:
    """The counters of a search of files(path, text, possibly size), in one pass and one row.

    Files below a skipped or ignored directory aren't encountered. A skipped directory is counted where the walk would
    stop, once; links are never followed and files that can't be read don't reach here, so that their counters are 0.
    """
    pattern = compiled(config)
    marked = with_status(files, config, rules, skip)
    hits = F.filter(F.split(as_text(files), "\n", -1), lambda x: pattern.matches(x))
    hit = F.when((F.col("status") == SEARCHED) & (F.octet_length("text") > 0) & pattern.may_match(as_text(files)), F.size(hits) > 0)
    rows = marked.select("path", "status", size_of(files).alias("size"), F.coalesce(hit, F.lit(False)).alias("hit"))
    met = ~F.col("status").isin("in_skipped_dir", "in_ignored_dir")
    status = lambda x: F.count_if(F.col("status") == x)
    zero = F.lit(0).cast("bigint")
    counted = rows.agg(
        F.count_if(met).alias("files_encountered"),
        status(SEARCHED).alias("files_searched"),
        F.count_if("hit").alias("files_contained_matches"),
        status("large").alias("files_skipped_large"),
        status("binary_ext").alias("files_skipped_as_binary_due_to_ext"),
        status("binary_probe").alias("files_skipped_as_binary_due_to_probe"),
        zero.alias("files_skipped_unreadable"),
        status("ignored").alias("files_skipped_gitignore"),
        status("by_index").alias("files_skipped_by_cache"),
        zero.alias("symlinks_followed"),
        zero.alias("symlinks_broken"),
        F.coalesce(F.sum(F.when(F.col("status") == SEARCHED, F.col("size"))), zero).alias("bytes_searched"),
    )
    return counted.crossJoin(_directory_stats(files, config, rules))


def _directory_stats(files: DataFrame, config: SearchConfig, rules: list[Rule] | None) -> DataFrame:
    """From the paths alone: each directory once, and whether the walk enters it."""
    found = files.select(F.explode(directories(F.col("path"))).alias("dir")).distinct()
    as_files = found.select(F.concat("dir", F.lit("/x")).alias("path"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("size"), "dir")
    inner = with_status(as_files, config, rules).select("dir", F.col("status").alias("own"))
    parent = F.when(F.contains(F.col("dir"), F.lit("/")), F.regexp_replace("dir", "/[^/]*$", "/x")).otherwise("x")
    outer = inner.select("own", parent.alias("path"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("size"))
    both = with_status(outer, config, rules)
    out = F.col("status").isin("in_skipped_dir", "in_ignored_dir")
    return both.agg(
        (F.count_if(~F.col("own").isin("in_skipped_dir", "in_ignored_dir")) + 1).alias("dirs_encountered"),
        F.count_if(~out & (F.col("own") == "in_skipped_dir")).alias("dirs_skipped_common"),
        F.count_if(~out & (F.col("own") == "in_ignored_dir")).alias("dirs_skipped_gitignore"),
    )


def stats_report(stats: DataFrame) -> DataFrame:
    """(line_no, line): the counters as readable text, with shares of what was encountered."""
    dirs = F.col("dirs_encountered") + F.col("dirs_skipped_common") + F.col("dirs_skipped_gitignore")

    def row(label: str, count: str, whole: Column) -> Column:
        share = F.when(whole == 0, 0.0).otherwise(F.col(count) * 100.0 / whole)
        return F.format_string("  %-25s %8d (%5.1f%%)", F.lit(label), F.col(count), share)

    files = F.col("files_encountered")
    parts = [
        F.lit("Search complete"), F.lit("Files Summary:"),
        row("Files encountered", "files_encountered", files), row("Files searched", "files_searched", files),
        row("Files contained matches", "files_contained_matches", files), row("Skipped (large)", "files_skipped_large", files),
        row("Skipped (binary ext)", "files_skipped_as_binary_due_to_ext", files), row("Skipped (binary probe)", "files_skipped_as_binary_due_to_probe", files),
        row("Skipped (unreadable)", "files_skipped_unreadable", files), row("Skipped (gitignore)", "files_skipped_gitignore", files),
        row("Skipped (cache)", "files_skipped_by_cache", files), F.lit("Bytes Summary:"),
        F.format_string("  %-25s %12s", F.lit("Bytes searched"), format_bytes(F.col("bytes_searched"))), F.lit("Directories Summary:"),
        row("Dirs encountered", "dirs_encountered", dirs), row("Skipped (common)", "dirs_skipped_common", dirs), row("Skipped (gitignore)", "dirs_skipped_gitignore", dirs),
    ]
    return stats.select(F.posexplode(F.array(*parts)).alias("line_no", "line"))
