"""Tables with a text column as corpora: a row is a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source/doc_id.txt"""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host/path of the url, without scheme, query and fragment."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"), F.col("html").alias("text"), "page_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id/turn-role.txt"""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("-"), F.col("role"), F.lit(".txt"))
    return rows.select(path.alias("path"), "text")


def events(rows: DataFrame) -> DataFrame:
    """The JSON text of events as files event_type/event_id.json; for streams as well."""
    path = F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".json"))
    return rows.select(path.alias("path"), F.col("props").alias("text"), F.col("ts").cast("timestamp").alias("ts"))
