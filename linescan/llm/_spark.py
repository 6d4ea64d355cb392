"""Shared-folder tables, size-checked joins and Arrow helpers used by the operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X

FILTER_BYTES = 32 << 20  # of a Bloom filter that is sent to all tasks, at most
FILTER_BITS = 12  # for an id
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of a job's shuffle files as soon as it ends

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or, where that is unset in a local session, one of our own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        at = getattr(sc, "_linescan_dir", None)
        if at is None:
            at = sc._linescan_dir = "file://" + tempfile.mkdtemp(prefix="linescan-")
            atexit.register(shutil.rmtree, at[7:], True)
            sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; it is removed when the session's process ends."""
    path = f"{shared_dir(spark)}/linescan/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if path.startswith("file:") or path.startswith("/"):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), True)
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be gone; then the cluster's own clean-up has the folder
        pass


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, and gives later joins its size."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def sparing(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run meanwhile send at most rows rows at once to Python, and leave no shuffle files behind."""
    was = {k: spark.conf.get(k, None) for k in (BATCH_ROWS, CLEAN_UP)}
    least = int(was[BATCH_ROWS] or 0)
    spark.conf.set(BATCH_ROWS, str(min(rows, least) if least > 0 else rows))
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        for k, value in was.items():
            if value is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, value)


def give_back() -> None:
    """Returns memory that a Python worker doesn't use any more to the system; else idle workers keep it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _bytes_limit(spark: SparkSession) -> int:
    value = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    value = value.removesuffix("b")
    if value and value[-1] in units:
        return int(value[:-1]) * units[value[-1]]
    return int(value)


def join_narrow(wide: DataFrame, narrow: DataFrame, on, how: str, row_bytes: int = 32) -> DataFrame:
    """Joins wide rows (texts) with a narrow, already saved table.

    The narrow side is broadcast if its counted rows fit spark.sql.autoBroadcastJoinThreshold; beyond that both
    sides are shuffled and the narrow one is hashed, so that the texts are never sorted.
    """
    limit = _bytes_limit(wide.sparkSession)
    small = limit > 0 and narrow.count() * row_bytes <= limit
    return wide.join(F.broadcast(narrow) if small else narrow.hint("shuffle_hash"), on, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """A vocabulary file of LINESCAN_TOKENIZERS, by default /opt/tokenizers."""
    return os.path.join(os.environ.get("LINESCAN_TOKENIZERS", "/opt/tokenizers"), name)


def file_bytes(docs: DataFrame) -> int:
    """About the size that docs(doc_id, text) has or would have as files; only for sizing partitions.

    That of its files where it is a scan of files; otherwise half the bytes of its texts, which are counted.
    """
    plan = docs._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if leaves.size() == 1 and leaves.apply(0).getClass().getSimpleName() == "LogicalRelation":
        return int(str(leaves.apply(0).stats().sizeInBytes()))
    found = docs.agg(F.sum(F.octet_length(docs.columns[-1]))).first()[0] or 0
    return found // 2


def partitions_for(docs: DataFrame, factor: float, each: int = 32 << 20) -> int:
    """How many partitions of about each bytes hold factor times the size of docs as files."""
    return max(int(file_bytes(docs) * factor / each) + 1, docs.sparkSession.sparkContext.defaultParallelism)


def with_long_id(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Only the columns doc_id BIGINT and text, whatever they are called and whatever else there is."""
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Three bits of a Bloom filter for each id."""
    h = X.mix(ids.view(np.uint64) + X.COEF[205])
    return (h + np.arange(3, dtype=np.uint64)[:, None] * (X.mix(h) | np.uint64(1))) % np.uint64(bits)


def may_hold(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a Bloom filter may hold each id; never False for one that it holds."""
    place = _places(ids, len(words) * 64)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).all(0)


def id_filter(ids: DataFrame) -> np.ndarray | None:
    """A Bloom filter of a saved table's BIGINT column, or None where it would be larger than FILTER_BYTES."""
    words = -(-ids.count() * FILTER_BITS // 64) + 1
    if words * 8 > FILTER_BYTES:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_places(batch.column(0).to_numpy(), words * 64))
            word, bit = (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))
            head = np.flatnonzero(np.diff(word, prepend=-1))
            merged = np.bitwise_or.reduceat(bit, head) if len(head) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[head]), pa.array(merged.view(np.int64))], ["word", "bits"])

    found = ids.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids, a saved table of doc_id BIGINT without nulls; null ids stay.

    Ids that fit spark.sql.autoBroadcastJoinThreshold are broadcast. Beyond that, rows that a Bloom filter of the ids
    rules out stay where they are, and only the others are joined with the ids; where the filter would be too large to
    send, all rows are joined.
    """
    if ids.count() * 16 <= _bytes_limit(docs.sparkSession):
        return docs.join(F.broadcast(ids), "doc_id", "left_anti")
    words = id_filter(ids)
    if words is None:
        return join_narrow(docs, ids, "doc_id", "left_anti", 16)
    held = docs.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def maybe(column: pd.Series) -> pd.Series:
        known = column.notna()
        return pd.Series(may_hold(held.value, column.fillna(0).to_numpy(np.int64)) & known.to_numpy())

    test = maybe(F.col("doc_id").cast("bigint"))
    return docs.where(~test).unionAll(join_narrow(docs.where(test), ids, "doc_id", "left_anti", 16))
