"""The corpus pipeline: stages that each work on what the stage before kept.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> mixing -> token blocks. Every stage is
a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. An empty
table gives an empty one; further columns are passed on as they are, whatever their names, but by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linescan.llm import decontaminate, mixing, ngram_join, quality, tokens
from linescan.llm._spark import read, saved


def without_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Every row is scored, by its whole text; null and empty texts and null ids too. Repeated rows and ties stay or go together.
    """
    return quality.filtered(docs, read(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near and exact copies.

    Rows without an id or without a word are in no group and stay.
    """
    return ngram_join.without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap with a benchmark item; null and empty texts have no overlap and stay."""
    return decontaminate.without_overlaps(docs, read(spark, sf_dir, "benchmark"), whole=True)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chooses documents so that the sources' tokens have their target weights; at least mixing.LEAST of the tokens stay.

    Rows with a null doc_id can't be chosen; rows that share one are chosen together. A null source is one of its own.
    """
    return mixing.mixed(docs, least=mixing.LEAST)


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the documents as blocks of token ids, a row for each; null and empty texts have no blocks."""
    return tokens.token_blocks(docs)


STAGES = [
    ("quality classifier", without_rejected),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_sources),
    ("token-ID / binary output", packed_tokens),
]
#: SQL can express neither the classifier nor the tokens; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return saved(STAGES[-1][1](spark, docs, sf_dir), "stage")
