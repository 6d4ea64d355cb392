"""Matches as text: per-line and per-file formats, with colours if wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linescan.config import DISPLAY_BYTES
from linescan.functions.scalars import truncated

RED, GREEN, CYAN, RESET = "\033[1;31m", "\033[1;32m", "\033[1;36m", "\033[0m"


def full_path(root: str, path: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), path) if root else path


def highlighted(text: Column, ranges: Column) -> Column:
    """The text with every byte span in red; spans behind its end are dropped, one across it is cut."""
    raw = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # a character for each byte
    size = F.octet_length(text)
    inside = F.filter(ranges, lambda r: (r["start"] < size) & (r["start"] < r["end"]))

    def add(state: Column, r: Column) -> Column:
        end = F.least(r["end"], size)
        lead = F.substring(raw, state["at"] + 1, r["start"] - state["at"])
        hit = F.substring(raw, r["start"] + 1, end - r["start"])
        return F.struct(end.alias("at"), F.concat(state["out"], lead, F.lit(RED), hit, F.lit(RESET)).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(inside, first, add, lambda s: F.concat(s["out"], F.substring(raw, s["at"] + 1, size)))
    return F.decode(F.encode(done, "ISO-8859-1"), "UTF-8")


def match_lines(found: DataFrame, root: str = "", jump: bool = True, color: bool = False, most: int = DISPLAY_BYTES) -> DataFrame:
    """path, line_num and formatted: path:N: text with jump, else N: text; the text is cut to most bytes."""
    shown = truncated(F.col("text"), most)
    if color:
        shown = highlighted(shown, F.col("ranges"))
    number, path = F.col("line_num").cast("string"), full_path(root, F.col("path"))
    if color:
        number, path = F.concat(F.lit(CYAN), number, F.lit(RESET)), F.concat(F.lit(GREEN), path, F.lit(RESET))
    head = F.concat(path, F.lit(":"), number) if jump else number
    return found.select("path", "line_num", F.concat(head, F.lit(": "), shown).alias("formatted"))


def with_headers(found: DataFrame, root: str = "", color: bool = False) -> DataFrame:
    """match_lines() without jump; the first line of each file has the file's header above it, and a newline."""
    first = F.row_number().over(W.partitionBy("path").orderBy("line_num")) == 1
    path = full_path(root, F.col("path"))
    head = F.concat(F.lit(GREEN), path, F.lit(f"{RESET}:\n")) if color else F.concat(path, F.lit(":\n"))
    out = match_lines(found, root, False, color)
    return out.withColumn("formatted", F.when(first, F.concat(head, "formatted")).otherwise(F.col("formatted")))
