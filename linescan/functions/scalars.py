"""Scalar functions of the search engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED_DIRS = ("node_modules", "target", ".git", ".hg", ".svn", "dist", "build", "out", "bin", "tmp", ".cache")
BINARY_EXTENSIONS = ("7z", "a", "bin", "class", "dll", "exe", "gif", "gz", "jpeg", "jpg", "o", "pdf", "png", "so", "tar", "zip")
GRAM_FACTOR = 0x9E3779B9
PROBE_CONTROL = 512
MOST_CONTROL = 51
_ANY_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_CONTROL = "".join(chr(i) for i in [*range(1, 9), 11, 12, *range(14, 32), 127])


def format_bytes(n: Column) -> Column:
    """Bytes as B, KB, MB or GB; halves are rounded to even digits."""
    return (
        F.when(n >= 1 << 30, F.format_string("%.2f GB", F.bround(n / (1 << 30), 2)))
        .when(n >= 1 << 20, F.format_string("%.2f MB", F.bround(n / (1 << 20), 2)))
        .when(n >= 1 << 10, F.format_string("%.2f KB", F.bround(n / (1 << 10), 2)))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def path_parent(path: Column) -> Column:
    """/a/b -> /a, /a -> /, / and a -> empty, a/b -> a; one slash at the end counts as none."""
    core = F.regexp_replace(path, "/$", "")
    at = F.length(core) - F.coalesce(F.length(F.substring_index(core, "/", -1)), F.lit(0))
    return F.when(~F.contains(core, F.lit("/")), "").when(at == 1, "/").otherwise(F.substring(core, F.lit(1), at - 1))


def file_name(path: Column) -> Column:
    """The last component; / for a path of slashes only."""
    core = F.rtrim(path, F.lit("/"))
    return F.when((core == "") & (path != ""), "/").otherwise(F.substring_index(core, "/", -1))


def extension(name: Column) -> Column:
    """What follows the last dot of a name, or null."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))


def components(path: Column) -> Column:
    """The directories that a path goes through."""
    parts = F.split(path, "/", -1)
    return F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")


def in_skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(components(path), F.array(*map(F.lit, SKIPPED_DIRS)))


def is_binary_text(text: Column) -> Column:
    """is_binary() of a STRING column; texts without any control character, the most, are told by one cheap test."""
    return F.substring(text, 1, 4096).rlike(_ANY_CONTROL) & is_binary(text.cast("binary"))


def is_binary(content: Column) -> Column:
    """A NUL in the first 4096 bytes, or more than 51 control characters in the first 512; for BINARY columns."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    first = F.substring(head, 1, PROBE_CONTROL)
    controls = F.length(first) - F.length(F.translate(first, _CONTROL, ""))
    return F.coalesce((F.instr(head, "\0") > 0) | (controls > MOST_CONTROL), F.lit(False))


def truncated(text: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most that many bytes."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    # bytes of a character that the cut split: its head, with fewer bytes behind it than it needs
    latin = F.decode(raw, "ISO-8859-1")
    cut = F.regexp_replace(latin, "(?:[À-ß]|[à-ï][\u0080-¿]?|[ð-÷][\u0080-¿]{0,2})$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8"))


def gram_hash(gram: Column) -> Column:
    """The 32-bit hash of a 4-byte fragment: little-endian, times an odd constant."""
    swapped = F.concat(*[F.substring(F.hex(gram), i, 2) for i in (7, 5, 3, 1)])
    number = F.conv(swapped, 16, 10).cast("decimal(20,0)")
    return (number * F.lit(GRAM_FACTOR).cast("decimal(12,0)") % F.lit(1 << 32).cast("decimal(12,0)")).cast("bigint")


def stride(size: Column) -> Column:
    """The sampling step of the older presence scan, kept for comparison: 1, 8 above 64 KiB, 64 above 1 MiB."""
    return F.when(size > 1 << 20, 64).when(size > 1 << 16, 8).otherwise(1)


def trimmed(text: Column) -> Column:
    """Without ASCII white space around."""
    return F.trim(text, F.lit(" \t\n\r\f"))


def filetime_to_unix(ticks: Column) -> Column:
    """Seconds since 1970 of a count of 100 ns since 1601, 0 before 1970."""
    return F.greatest((ticks / 10_000_000).cast("bigint") - 11_644_473_600, F.lit(0))


def byte_grams(text: Column, n: int = 4) -> Column:
    """The distinct n-byte windows of a text, as BINARY."""
    raw = F.encode(text, "UTF-8")
    last = F.octet_length(text) - (n - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(raw, i, F.lit(n))))).otherwise(F.array().cast("array<binary>"))
