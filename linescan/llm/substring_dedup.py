"""Substring deduplication: super-k-mer partitioning of the word windows of all texts.

A window is k consecutive words. Its minimiser is the smallest hash of the m-word runs within it. Consecutive
windows of a text that share a minimiser travel as one packed string (their words, once) to the bucket of that
minimiser, so that equal windows meet; sorting the windows of a bucket counts each of them exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as X
from ._spark import partitions_for, read, with_long_id

K = 50
M = 8
CHUNK = 2 << 20
BUCKETS = 4  # in a partition: only one is in memory
NULL_ID = -(1 << 63)


def _packed(k: int, m: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def chunk(ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch | None:
        words = X.split_words(texts)
        n = len(words.start)
        if n < k:
            return None
        lowest = X.sliding_min(X.grams(words.hashes(), m), k - m + 1)
        whole = np.arange(n - k + 1) + k <= words.first[words.doc[: n - k + 1] + 1]
        at = np.flatnonzero(whole)
        if not len(at):
            return None
        lowest, doc = lowest[at], words.doc[at]
        cut = np.ones(len(at), bool)
        cut[1:] = (lowest[1:] != lowest[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(cut)
        windows = np.diff(np.append(head, len(at)))
        first, bucket = at[head], X.mix(lowest[head]) % np.uint64(buckets)
        size = words.end - words.start + 1
        to = np.concatenate(([0], np.cumsum(size)))
        index = np.repeat(words.start - to[:-1], size) + np.arange(to[-1])
        packed = words.data[np.minimum(index, len(words.data) - 1)]
        packed[to[1:] - 1] = 32
        view = memoryview(packed)
        order = np.argsort(bucket, kind="stable")
        bucket, first, windows = bucket[order].astype(np.int64), first[order], windows[order]
        edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        lo, hi = to[first].tolist(), to[first + windows + k - 1].tolist()
        doc = ids[words.doc[first]]
        place = (first - words.first[words.doc[first]]).astype(np.int32)
        zip_ = zstandard.ZstdCompressor(level=1)
        rows = [
            (
                int(bucket[a]),
                doc[a:b].tobytes(),
                place[a:b].tobytes(),
                windows[a:b].astype(np.int32).tobytes(),
                zip_.compress(b"".join([view[x:y] for x, y in zip(lo[a:b], hi[a:b], strict=True)])),
            )
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)
        ]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            ["bucket", "docs", "places", "windows", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            texts = X.text_array(batch.column(1))
            for lo, hi in X.chunks(texts, CHUNK):
                if (out := chunk(ids[lo:hi], texts.slice(lo, hi - lo))) is not None:
                    yield out

    return run


def _window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, by doubling."""
    out, done, power, length = None, 0, h, 1
    while True:
        if k & length:
            if out is None:
                out = power
            else:
                n = len(h) - done - length + 1
                out = X.mix(out[:n] * X.COEF[done] + power[done : done + n] * X.COEF[done + 1])
            done += length
        if done == k:
            return out
        n = len(power) - length
        power = X.mix(power[:n] * X.COEF[length % 4096] + power[length : length + n])
        length *= 2


def _word_numbers(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the packed strings, and a number that is equal for equal words only."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    hashes, base, starts, ends = [], 0, [], []
    for part in parts:
        own = np.frombuffer(part, np.uint8)
        end = np.flatnonzero(own == 32)
        start = np.concatenate(([0], end[:-1] + 1))
        hashes.append(X.Words(own, start, end, end, end).hashes())
        starts.append(start + base)
        ends.append(end + base)
        base += len(own)
    h, start, end = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    _, sample, number = np.unique(h, return_index=True, return_inverse=True)
    like = sample[number]
    size = end - start
    same = size == size[like]
    for lo in range(0, len(h), 1 << 17):
        s = size[lo : lo + (1 << 17)] * same[lo : lo + (1 << 17)]
        within = X.spans(s)
        a = data[np.repeat(start[lo : lo + (1 << 17)], s) + within]
        b = data[np.repeat(start[like[lo : lo + (1 << 17)]], s) + within]
        if (a != b).any():
            same[lo + np.repeat(np.arange(len(s)), s)[a != b]] = False
    if not same.all():  # two words with one hash: number those by their bytes
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(~same):
            number[i] = known.setdefault(data[start[i] : end[i]].tobytes(), len(sample) + len(known))
        h = X.mix(number.astype(np.uint64))
    return h, number


def _repeats(doc: np.ndarray, place: np.ndarray, windows: np.ndarray, parts: list[bytes], k: int) -> pa.RecordBatch | None:
    """The runs of repeated windows of one bucket."""
    h, number = _word_numbers(parts)
    run_of = np.repeat(np.arange(len(doc)), windows)
    at = np.repeat(np.concatenate(([0], np.cumsum(windows + k - 1)))[:-1], windows) + X.spans(windows)
    own_doc, own_place = doc[run_of], place[run_of] + X.spans(windows)
    hashed = _window_hashes(h, k)[at]
    order = np.lexsort((own_place, own_doc, hashed)) if len(hashed) else hashed.astype(np.int64)
    ordered = hashed[order]
    equal = ordered[1:] == ordered[:-1]
    pair = np.flatnonzero(equal)
    p, q = at[order[pair]], at[order[pair + 1]]
    bad = np.zeros(len(pair), bool)
    for j in range(k):
        bad |= number[p + j] != number[q + j]
    if bad.any():  # different windows with one hash: sort those by their words
        exact: dict[bytes, int] = {}
        key = np.searchsorted(np.unique(ordered), hashed).astype(np.int64)
        for i in np.flatnonzero(np.isin(hashed, ordered[pair[bad]])):
            key[i] = -1 - exact.setdefault(number[at[i] : at[i] + k].tobytes(), len(exact))
        order = np.lexsort((own_place, own_doc, key))
        equal = key[order][1:] == key[order][:-1]
    if not equal.any():
        return None
    group = np.concatenate(([0], np.cumsum(~equal)))
    size = np.bincount(group)
    copies, later = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    copies[order] = size[group]
    later[order] = np.concatenate(([False], equal))
    hit = np.flatnonzero(copies > 1)
    cut = np.ones(len(hit), bool)
    cut[1:] = (np.diff(hit) > 1) | (np.diff(run_of[hit]) > 0)
    head = np.flatnonzero(cut)
    id_ = own_doc[hit[head]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(id_, pa.int64(), mask=id_ == NULL_ID),
            pa.array(own_place[hit[head]], pa.int32()),
            pa.array(np.diff(np.append(head, len(hit))), pa.int32()),
            pa.array(np.add.reduceat(later[hit], head), pa.int32()),
            pa.array(np.maximum.reduceat(copies[hit], head), pa.int64()),
        ],
        ["doc_id", "place", "windows", "later", "copies"],
    )


def _counted(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready() -> pa.RecordBatch | None:
            doc, place, windows = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in ((0, np.int64), (1, np.int32), (2, np.int32)))
            unzip = zstandard.ZstdDecompressor()
            return _repeats(doc, place, windows, [unzip.decompress(x[3]) for x in held], k)

        bucket, held = None, []
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and held:
                    if (out := ready()) is not None:
                        yield out
                    held = []
                bucket = b
                held.append(row)
        if held and (out := ready()) is not None:
            yield out

    return run


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every maximal stretch of windows that occur at least twice in the corpus.

    Result: doc_id, start_word, end_word (words from 0, end exclusive), windows, later_windows (those of which
    a smaller (doc_id, word) has a copy: what deduplication would cut) and max_copies (of its most frequent window).

    A null text is an empty one; texts of fewer than k words have no window. A null doc_id is an id like any
    other (and comes first). Rows that share a doc_id are copies in the counts; their stretches are reported once,
    joined, with later_windows summed over the rows. Other columns are ignored, whatever their names. An empty table has no stretches.
    """
    if not 1 <= m <= k:
        raise ValueError("1 <= m <= k")
    own = with_long_id(docs, doc_id, text)
    # a packed string has about 3 times the words of its text; files about half the bytes of the texts
    parts = partitions_for(own, 2.0 * (1 + k / max(1, (k - m + 2) / 2)))
    packed = own.mapInArrow(_packed(k, m, parts * BUCKETS), "bucket int, docs binary, places binary, windows binary, words binary")
    runs = (
        packed.repartitionById(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_counted(k), "doc_id bigint, place int, windows int, later int, copies bigint")
    )
    by = W.partitionBy("doc_id").orderBy("place", "windows")
    before = F.max(F.col("place") + F.col("windows")).over(by.rowsBetween(W.unboundedPreceding, -1))
    return (
        runs.withColumn("cut", F.when(F.col("place") <= before, 0).otherwise(1))
        .withColumn("island", F.sum("cut").over(by.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "island")
        .agg(
            F.min("place").alias("start_word"),
            (F.max(F.col("place") + F.col("windows")) + (k - 1)).alias("end_word"),
            (F.max(F.col("place") + F.col("windows")) - F.min("place")).alias("windows"),
            F.sum("later").alias("later_windows"),
            F.max("copies").alias("max_copies"),
        )
        .drop("island")
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents"))


SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '{X.WORD_SQL}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + {K}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {K - 1})) AS i FROM words WHERE len(w) >= {K})
),
counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS copies,
         row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later
  FROM windows
),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM counted WHERE copies > 1)
SELECT doc_id, min(i)::INT AS start_word, (max(i) + {K})::INT AS end_word, (max(i) - min(i) + 1)::INT AS windows,
       count(*) FILTER (WHERE later) AS later_windows, max(copies) AS max_copies
FROM islands GROUP BY doc_id, g
"""
