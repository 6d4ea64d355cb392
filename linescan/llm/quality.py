"""Quality classifier: Bradley-Terry ranking of documents, learned from preference pairs.

A pair says that a document labelled good (quality 1, not toxic) is preferred to one labelled bad (quality 0 or
toxic). Scores are linear in a document's features; their weights minimise the logistic loss on the difference of
the features of the two documents of a pair. A document is kept if its score reaches a quantile of the scores of
all documents labelled good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import join_narrow, read, saved, with_long_id

SAMPLE = 3000  # labelled documents of either kind that the weights are fitted on, at most
PAIRS = 12000
WORDS = 512  # words that get a weight of their own
QUANTILE = 0.005
SEED = 17
BITS = 20
DENSE = 129 + 6
CHUNK = 2 << 20

_KIND = np.minimum(np.arange(256), 128)


@dataclass
class Model:
    """Weights of the standardised dense features and of the presence of chosen words."""

    weight: np.ndarray
    shift: np.ndarray
    word: np.ndarray  # 1 + the number of a word's feature, by the first bits of its hash
    word_weight: np.ndarray


def dense(texts: pa.Array, words: X.Words) -> np.ndarray:
    """Of each text: root of the share of each ASCII byte and of all others, and shape of words and lines."""
    data, offsets = X.raw(texts)
    n, size = len(texts), np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    count = np.bincount(row * 129 + _KIND[data], minlength=n * 129).reshape(n, 129).astype(np.float64)
    length = np.diff(words.first)
    letters = np.bincount(words.doc, words.end - words.start, n)
    own = words.doc.astype(np.uint64) << np.uint64(40) | words.hashes() >> np.uint64(24)
    different = np.bincount((np.unique(own) >> np.uint64(40)).astype(np.int64), minlength=n)
    some = np.maximum(length, 1)
    more = [
        np.log1p(length),
        different / some,
        letters / some,
        np.log1p(count[:, 10]),
        count[:, 65:91].sum(1) / np.maximum(count[:, 97:123].sum(1) + count[:, 65:91].sum(1), 1),
        length / np.maximum(count[:, 10] + 1, 1) / 50,
    ]
    return np.column_stack([np.sqrt(count / np.maximum(size, 1)[:, None]), *more])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = X.text_array(batch.column(1))
        for lo, hi in X.chunks(texts, CHUNK):
            part = texts.slice(lo, hi - lo)
            words = X.split_words(part)
            pairs = np.unique(words.doc.astype(np.uint64) << np.uint64(BITS) | words.hashes() >> np.uint64(64 - BITS))
            of = np.searchsorted(pairs >> np.uint64(BITS), np.arange(hi - lo + 1))
            codes = (pairs & np.uint64((1 << BITS) - 1)).astype(np.int32)
            table = dense(part, words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([x.tobytes() for x in table], pa.binary()),
                    pa.array([codes[a:b].tobytes() for a, b in zip(of[:-1], of[1:], strict=True)], pa.binary()),
                ],
                ["doc_id", "dense", "codes"],
            )


def _logistic(d: np.ndarray, ridge: float, steps: int = 250) -> np.ndarray:
    """Weights of the least logistic loss on the differences d, by accelerated gradient."""
    w = v = np.zeros(d.shape[1])
    vector = np.ones(d.shape[1])
    for _ in range(15):
        vector = d.T @ (d @ vector)
        norm = np.linalg.norm(vector)
        vector /= max(norm, 1e-12)
    rate = 1 / (norm / len(d) / 4 + ridge)
    for i in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ v, -50, 50)))
        new = v - rate * (ridge * v - d.T @ p / len(d))
        v, w = new + i / (i + 3) * (new - w), new
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model | None:
    """Fits on at most sample documents labelled good and as many labelled bad; None where either kind is missing."""
    ranked = _judged(labels).distinct()
    chosen = None
    for good in (True, False):
        part = ranked.where(F.col("good") == good).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = saved(chosen, "labels")
    rows = join_narrow(docs, chosen, "doc_id", "inner").select("doc_id", "text", "good")
    marked = rows.select(F.struct("doc_id", "good").alias("key"), "text")
    found = marked.mapInArrow(_features, "doc_id struct<doc_id:bigint,good:boolean>, dense binary, codes binary").collect()
    found.sort(key=lambda r: (r.doc_id.doc_id, r.doc_id.good, bytes(r.dense)))
    good = np.array([r.doc_id.good for r in found], bool)
    if good.all() or not good.any():
        return None
    table = np.array([np.frombuffer(r.dense) for r in found])
    codes = [np.frombuffer(r.codes, np.int32) for r in found]
    both = np.zeros((2, 1 << BITS))
    for g, c in zip(good, codes, strict=True):
        both[int(g), c] += 1
    n = np.array([(~good).sum(), good.sum()])
    share = both / n[:, None]
    pooled = both.sum(0) / n.sum()
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n).sum())
    z = np.where(both.sum(0) >= 4, (share[0] - share[1]) / spread, 0)
    top = np.argsort(-np.abs(z), kind="stable")[:WORDS]
    top = top[np.abs(z[top]) > 3.5]
    word = np.zeros(1 << BITS, np.int16)
    word[top] = np.arange(1, len(top) + 1)
    presence = np.zeros((len(found), len(top) + 1))
    for i, c in enumerate(codes):
        presence[i, word[c]] = 1
    mean, std = table.mean(0), table.std(0)
    scale = np.where(std > 1e-9, 1 / np.maximum(std, 1e-9), 0)
    x = np.hstack([np.clip((table - mean) * scale, -6, 6), 3 * presence[:, 1:]])
    rng = np.random.default_rng(seed)
    a, b = rng.choice(np.flatnonzero(good), PAIRS), rng.choice(np.flatnonzero(~good), PAIRS)
    w = _logistic(x[a] - x[b], 1e-4)
    return Model(w[:DENSE], np.vstack([mean, scale]), word, 3 * np.append(0, w[DENSE:]))


def _scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    texts = X.text_array(texts)
    out = np.zeros(len(texts))
    if model is None:
        return out
    for lo, hi in X.chunks(texts, CHUNK):
        part = texts.slice(lo, hi - lo)
        words = X.split_words(part)
        x = np.clip((dense(part, words) - model.shift[0]) * model.shift[1], -6, 6)
        feature = model.word[(words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)]
        at = np.flatnonzero(feature)
        pair = np.unique(words.doc[at] * (WORDS + 1) + feature[at])
        lexical = np.bincount(pair // (WORDS + 1), model.word_weight[pair % (WORDS + 1)], hi - lo)
        out[lo:hi] = np.round((x * model.weight).sum(1) + lexical, 6)
    return out


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(_scores(model, batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), score], ["doc_id", "score"])

    return run


def _judged(labels: DataFrame) -> DataFrame:
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    return (
        labels.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.when((F.col("quality") == 0) | toxic, False).when(F.col("quality") == 1, True).alias("good"),
        )
        .where("doc_id IS NOT NULL AND good IS NOT NULL")
    )


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id bigint, score double")


def cut(scores: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> float:
    """That quantile of the scores of all documents labelled good; minus infinity where there are none."""
    good = _judged(labels).where("good").select("doc_id").distinct()
    found = scores.join(good, "doc_id").agg(F.percentile_approx("score", quantile, 100000).alias("q")).first().q
    return float("-inf") if found is None else found


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with doc_id and score.

    A null text is an empty one. A null doc_id is never labelled, but scored and kept or rejected like others.
    Rows that repeat one another get one score, and stay or go together; so do ties with the threshold, which
    stay. Labels with a null doc_id or quality (unless toxic) say nothing. Where there is no document of either
    kind, every score is 0 and all rows stay. Other columns are ignored.
    """
    own = with_long_id(docs, "doc_id", "text")
    scores = saved(scored(own, fit(own, labels, sample)), "scores")
    return scores.where(F.col("score") >= cut(scores, labels, quantile))


def filtered(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, sample: int = SAMPLE) -> DataFrame:
    """docs, all columns, without the rows that the classifier rejects; as kept().

    The texts are scored twice, for the threshold and for the choice, which is cheaper than to shuffle them.
    """
    own = with_long_id(docs, "doc_id", "text")
    model = fit(own, labels, sample)
    least = cut(saved(scored(own, model), "scores"), labels, quantile)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(names.index("text"))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
