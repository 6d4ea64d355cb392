"""A persistent index of 4-byte fragments, by which later searches skip files that can't match.

A row (path, mtime, size, gram, present) says that this version of the file was checked for the fragment, and whether
it has it. No row means unknown: the file must be searched. So a search with the index finds what it finds without.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linescan.errors import BrokenImage
from linescan.functions.pattern import Pattern
from linescan.operators.filters import content, size_of

FORMAT_VERSION = 1
SCHEMA = "path string, mtime bigint, size bigint, gram binary, present boolean"


def version(files: DataFrame) -> list[Column]:
    mtime = F.col("mtime") if "mtime" in files.columns else F.lit(0)
    return [F.col("path"), mtime.cast("bigint").alias("mtime"), size_of(files).cast("bigint").alias("size")]


def build(files: DataFrame, grams: list[bytes]) -> DataFrame:
    """The index rows of all files for these fragments; each content is scanned in full, none is sampled."""
    raw = F.decode(content(files), "ISO-8859-1")  # a character for each byte
    tests = [F.struct(F.lit(bytearray(g)).alias("gram"), F.coalesce(F.contains(raw, F.lit(g.decode("latin-1"))), F.lit(False)).alias("present")) for g in grams]
    if not tests:
        return files.sparkSession.createDataFrame([], SCHEMA)
    return files.select(*version(files), F.explode(F.array(*tests)).alias("row")).select("path", "mtime", "size", "row.gram", "row.present")


def pattern_grams(pattern: Pattern) -> list[bytes]:
    """All fragments worth checking for a pattern; none, and so no use of the index, for patterns under 4 bytes."""
    return sorted({g for way in pattern.fragments() for g in way})


def upserted(index: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; of a file's versions only the newest, and of what was checked twice the later check."""
    both = index.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    newest = F.max(F.struct("age", "mtime", "size")).over(W.partitionBy("path"))
    fresh = both.withColumn("newest", newest).where("mtime = newest.mtime AND size = newest.size")
    return fresh.groupBy("path", "mtime", "size", "gram").agg(F.max_by("present", "age").alias("present"))


def skippable(index: DataFrame, files: DataFrame, pattern: Pattern) -> DataFrame:
    """(path) of the files that can't match: every way to match lacks one of its fragments, on this very version."""
    ways = pattern.fragments()
    if not ways or any(not way for way in ways):
        return index.select("path").limit(0)
    wanted = sorted({g for way in ways for g in way})
    absent = index.where(~F.col("present") & F.col("gram").isin(*[bytearray(g) for g in wanted]))
    per_file = absent.groupBy("path", "mtime", "size").agg(F.collect_set(F.hex("gram")).alias("lacks"))
    for way in ways:
        per_file = per_file.where(F.arrays_overlap("lacks", F.array(*[F.lit(g.hex().upper()) for g in way])))
    return per_file.join(files.select(*version(files)), ["path", "mtime", "size"], "left_semi").select("path")


def outcome(index: DataFrame, files: DataFrame, pattern: Pattern) -> DataFrame:
    """One row: files that the index skips (hits), knows in this version (known), in another (stale), or not at all."""
    now = files.select(*version(files))
    known = index.select("path", F.col("mtime").alias("m"), F.col("size").alias("s")).distinct()
    skip = skippable(index, files, pattern).distinct().withColumn("hit", F.lit(True))
    same = F.coalesce((F.col("m") == F.col("mtime")) & (F.col("s") == F.col("size")), F.lit(False))
    rows = now.join(known, "path", "left").join(skip, "path", "left")
    return rows.agg(
        F.count_if("hit").alias("hits"),
        F.count_if(same).alias("known"),
        F.count_if(F.col("m").isNotNull() & ~same).alias("stale"),
        F.count_if(F.col("m").isNull()).alias("unknown"),
    )


def save(index: DataFrame, folder: str) -> None:
    """Writes a new version beside the old one, then points to it; a reader sees one or the other."""
    spark = index.sparkSession
    name = f"v{FORMAT_VERSION}-{uuid.uuid4().hex}"
    index.write.parquet(f"{folder}/{name}")
    pointer = json.dumps({"format_version": FORMAT_VERSION, "current": name})
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(path, True)
    out.write(bytearray(pointer.encode()))
    out.close()


def load(spark: SparkSession, folder: str, rebuild: bool = False) -> DataFrame:
    """The index of a folder; an empty one where there is none, or it is to be rebuilt."""
    found = None if rebuild else _pointer(spark, folder)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    if found.get("format_version") != FORMAT_VERSION:
        raise BrokenImage(f"index of format {found.get('format_version')} in {folder}")
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{found['current']}")


def _pointer(spark: SparkSession, folder: str) -> dict | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    rows = spark.read.text(f"{folder}/CURRENT").collect()
    return json.loads("".join(r.value for r in rows))
