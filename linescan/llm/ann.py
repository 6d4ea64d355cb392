"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a sample is cut into balanced parts that keep neighbours together; a small classifier (softmax
regression on the vectors) learns in which parts the neighbours of a vector are. All vectors are put in their most
probable part and, as queries, routed to the most probable ones until these have a share of the probability, which
is chosen so that the sample's neighbours are found; the vectors of those parts are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import read, saved

K = 10
RECALL = 0.95  # of the sample's neighbours that routing finds
PART_ROWS = 2048  # vectors in a part, on average
SAMPLE = 16384  # vectors that the graph and the classifier are made from, at most
LEAST = 32  # vectors of the sample in a part, at least
GRAPH = 10
SLACK = 1.1
SEED = 29
BLOCK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), BLOCK):
        near = x[lo : lo + BLOCK] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -np.inf
        out[lo : lo + BLOCK] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else out[lo : lo + BLOCK]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """A part for each row: halved along main directions, then moved to the neighbours' part while there is room."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        own = x[rows] - x[rows].mean(0)
        direction = rng.standard_normal(x.shape[1])
        for _ in range(8):
            direction = own.T @ (own @ direction)
            direction /= max(np.linalg.norm(direction), 1e-12)
        order, left = np.argsort(own @ direction, kind="stable"), n // 2
        cut = len(rows) * left // n
        todo += [(rows[order[:cut]], first, left), (rows[order[cut:]], first + left, n - left)]
    linked: list[list[int]] = [[] for _ in range(len(x))]
    for i, row in enumerate(graph.tolist()):
        linked[i].extend(row)
        for j in row:
            linked[j].append(i)
    most, size, of = int(np.ceil(len(x) / parts * SLACK)), np.bincount(part, minlength=parts).tolist(), part.tolist()
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            count: dict[int, int] = {}
            for j in linked[i]:
                count[of[j]] = count.get(of[j], 0) + 1
            here = count.get(of[i], 0)
            best = max((p for p in count if size[p] < most), key=lambda p: (count[p], -p), default=of[i])
            if count.get(best, 0) > here:
                size[of[i]] -= 1
                size[best] += 1
                of[i], moved = best, moved + 1
        if not moved:
            break
    return np.array(of)


def classifier(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Weights, with a bias, of softmax regression on the parts of a row's neighbours and its own, by Adam in batches."""
    z = np.hstack([x, np.ones((len(x), 1), np.float32)])
    target = np.zeros((len(x), parts), np.float32)
    for near in graph.T:
        target[np.arange(len(x)), part[near]] += 1
    target[np.arange(len(x)), part] += 2
    target /= target.sum(1, keepdims=True)
    w = np.zeros((z.shape[1], parts), np.float32)
    for p in range(parts):  # begin with the parts' directions
        if (own := part == p).any():
            w[:-1, p] = 8 * x[own].mean(0)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(rounds):
        order = rng.permutation(len(z))
        for lo in range(0, len(z), 512):
            rows, t = order[lo : lo + 512], t + 1
            g = z[rows].T @ (_probable(z[rows] @ w) - target[rows]) / len(rows)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _probable(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _ranked(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of each row from the most probable on, and the probability of those before each."""
    p = _probable(x @ w[:-1] + w[-1])
    order = np.argsort(-p, axis=1, kind="stable")
    ordered = np.take_along_axis(p, order, 1)
    return order, np.cumsum(ordered, 1) - ordered


def fit(vectors: DataFrame, rows: int, part_rows: int, sample: int, recall: float, seed: int) -> tuple[np.ndarray, float]:
    """The classifier's weights and the share of probability to probe; vectors(vec_id, embedding) are distinct and clean."""
    parts = max(1, min(-(-rows // part_rows), min(rows, sample) // LEAST))
    chosen = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).toArrow()
    x = unit(np.array(chosen["embedding"].to_pylist(), np.float32))
    rng = np.random.default_rng(seed)
    graph = neighbour_graph(x, GRAPH)
    w = classifier(x, balanced_parts(x, graph, parts, rng), graph, parts, rng)
    order, before = _ranked(x, w)
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(before, np.take_along_axis(place, order[:, 0][graph], 1), 1)
    return w, float(np.quantile(needed, recall)) if needed.size else 0.0


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float32)


def _routed(w: np.ndarray, share: float):
    width = len(w) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column(1), width))
            order, before = _ranked(x, w)
            row, nth = np.nonzero(before <= share)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(order[row, nth].astype(np.int32)),
                    pa.array(nth == 0),
                    batch.column(0).take(pa.array(row)),
                    pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(row)),
                ],
                ["part", "home", "vec_id", "vector"],
            )

    return run


def _nearest(k: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        x = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float32).reshape(-1, width)
        home = table["home"].to_numpy()
        items = np.flatnonzero(home)
        items = items[np.argsort(ids[items], kind="stable")]
        target, names = x[items], ids[items]
        found_q, found_n, found_s = [], [], []
        for lo in range(0, len(ids), BLOCK):
            if not len(items):
                break
            near = x[lo : lo + BLOCK] @ target.T
            near[ids[lo : lo + BLOCK, None] == names] = -np.inf
            n = min(k, len(items))
            edge = -np.partition(-near, n - 1, axis=1)[:, n - 1]
            row, column = np.nonzero((near >= edge[:, None]) & (near > -np.inf))  # ties with the last stay
            order = np.lexsort((column, -near[row, column], row))
            row, column = row[order], column[order]
            use = np.arange(len(row)) - np.searchsorted(row, row) < k
            found_q.append(ids[lo + row[use]])
            found_n.append(names[column[use]])
            found_s.append(near[row[use], column[use]])
        if not found_q:
            return pa.table({"vec_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float32())})
        return pa.table({"vec_id": np.concatenate(found_q), "neighbour_id": np.concatenate(found_n), "similarity": np.concatenate(found_s)})

    return run


def nearest(vectors: DataFrame, k: int = K, recall: float = RECALL, part_rows: int = PART_ROWS, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """vec_id, rank (from 1), neighbour_id and similarity (cosine) of the k nearest others of every vector.

    vectors(vec_id, embedding). Rows with a null id or embedding, with null, NaN or infinite numbers, or of another
    length than most (of several most frequent, the longest) are no vectors. Rows that share a vec_id are one vector,
    the smallest. A zero vector is unlike all: its similarities are 0. Ties go by neighbour_id. Fewer than k others:
    fewer rows. An empty table has no neighbours. Other columns are ignored. sample bounds what the graph and the
    classifier are made from; all vectors are searched, and searched for.
    """
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    usable = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf'))"
    own = own.where(usable)
    lengths = own.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    schema = "vec_id bigint, rank int, neighbour_id bigint, similarity float"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    clean = saved(own.where(F.size("embedding") == lengths.width).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    w, share = fit(clean, clean.count(), part_rows, sample, recall, seed)
    routed = clean.mapInArrow(_routed(w, share), "part int, home boolean, vec_id bigint, vector binary")
    found = routed.groupBy("part").applyInArrow(_nearest(k, lengths.width), "vec_id bigint, neighbour_id bigint, similarity float")
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "similarity")


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
