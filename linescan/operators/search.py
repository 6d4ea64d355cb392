"""The core query: files -> lines -> matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescan.config import SearchConfig
from linescan.functions.pattern import Pattern, compile_pattern
from linescan.operators.filters import SEARCHED, with_status
from linescan.operators.ignore import Rule


def compiled(config: SearchConfig) -> Pattern:
    return compile_pattern(config.pattern, config.force_literal, config.compat_alternation)


def as_text(files: DataFrame) -> Column:
    """The content as a string; of binary content that isn't UTF-8, with replacements."""
    text = F.col("text")
    if dict(files.dtypes)["text"] == "string":
        return text
    return F.when(F.is_valid_utf8(text.cast("string")), text.cast("string")).otherwise(F.make_valid_utf8(text.cast("string")))


def lines(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A row for each line: the columns keep (path, where it isn't given), line_num from 1, and line.

    Lines end at a newline only. A newline at the end is followed by one more, empty, line; an empty or null text has
    no lines.
    """
    keep = ["path"] if keep is None else keep
    some = files.where(F.octet_length("text") > 0)
    exploded = some.select(*keep, F.posexplode(F.split(as_text(files), "\n", -1)).alias("pos", "line"))
    return exploded.select(*keep, (F.col("pos") + 1).alias("line_num"), "line")


def matching_lines(files: DataFrame, pattern: Pattern, keep: list[str] | None = None) -> DataFrame:
    """lines() that match; texts that can't have one are dropped before they are split."""
    hopeful = files.where(pattern.may_match(as_text(files)))
    return lines(hopeful, keep).where(pattern.matches(F.col("line")))


def search(
    files: DataFrame, config: SearchConfig, rules: list[Rule] | None = None, skip: DataFrame | None = None, root: str = "", ranges: bool = True, keep: list[str] | None = None
) -> DataFrame:
    """path, line_num, text and ranges (byte spans) of every matching line of the files that the filters let through.

    files: path, text (STRING or BINARY) and possibly size. Nothing is shuffled unless skip, the index's verdict, is
    too large to broadcast. Where ranges aren't wanted, they aren't computed.
    """
    pattern = compiled(config)
    hopeful = files.where(pattern.may_match(as_text(files)))  # the cheapest test of a text, so before the filters
    chosen = with_status(hopeful, config, rules, skip, root).where(F.col("status") == SEARCHED)
    keep = ["path"] if keep is None else keep
    found = lines(chosen, keep).where(pattern.matches(F.col("line")))
    columns = [*keep, "line_num", F.col("line").alias("text")]
    return found.select(*columns, pattern.spans(F.col("line")).alias("ranges")) if ranges else found.select(*columns)


def span_rows(found: DataFrame) -> DataFrame:
    """A row for each span of search()'s matches."""
    # the outer form, since the plain one tests the ranges for emptiness first, which computes them twice
    spread = found.select("path", "line_num", F.explode_outer("ranges").alias("span")).where("span IS NOT NULL")
    return spread.select("path", "line_num", F.col("span.start").alias("start_byte"), F.col("span.end").alias("end_byte"))


def count_per_file(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.size("ranges")).alias("n_matches"))


def files_with_matches(found: DataFrame) -> DataFrame:
    return found.select("path").distinct()


def files_without_matches(files: DataFrame, config: SearchConfig, rules: list[Rule] | None = None) -> DataFrame:
    """Searched files with no matching line; decided file by file, without a join."""
    pattern = compiled(config)
    chosen = with_status(files, config, rules).where(F.col("status") == SEARCHED)
    split = F.filter(F.split(as_text(chosen), "\n", -1), lambda x: pattern.matches(x))
    hit = (F.octet_length("text") > 0) & pattern.may_match(as_text(chosen)) & (F.size(split) > 0)
    return chosen.where(~F.coalesce(hit, F.lit(False))).select("path")
