"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a budget of tokens. Documents are counted by source and exact token length; a source's budget is
filled in proportion to the counts in a seeded order of lengths, and the rest that leaves is fitted exactly by
bounded-knapsack dynamic programming over the lengths still at hand. Of each length the planned number of
documents is taken, in the order of a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as X
from . import tokens
from ._spark import read, saved, tokenizer_file, without_ids

SEED = 23
TEMPER = 0.7  # without weights, a source's weight is its share of the tokens to this power
LEAST = 0.75  # of all tokens, that the query and the pipeline keep at least
#: The rest that dynamic programming fits, in multiples of the source's longest document; more where it can't be.
RESTS = (2, 8, 32)


def fit_rest(lengths: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """How many of each length, at most counts, have the largest sum of at most rest."""
    take = np.zeros(len(lengths), np.int64)
    usable = np.flatnonzero((lengths > 0) & (lengths <= rest) & (counts > 0))
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    via = np.full(rest + 1, -1, np.int32)
    pieces: list[tuple[int, int]] = []
    for i in usable.tolist():
        left, copies = min(int(counts[i]), rest // int(lengths[i])), 1
        while left > 0 and not reached[rest]:
            copies = min(copies, left)
            weight = copies * int(lengths[i])
            if weight <= rest:
                new = np.flatnonzero(reached[: rest + 1 - weight] & ~reached[weight:]) + weight
                reached[new] = True
                via[new] = len(pieces)
            pieces.append((i, copies))
            left -= copies
            copies *= 2
        if reached[rest]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, copies = pieces[via[at]]
        take[i] += copies
        at -= copies * int(lengths[i])
    return take


def plan(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take: their tokens are the budget, or the most below that is found.

    Where all documents fit, all are taken. Documents of no tokens cost nothing and are taken.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    order = np.argsort(X.mix(lengths.astype(np.uint64) + np.uint64(seed * int(X.COEF[300]) % 2**64)), kind="stable")
    size, have = lengths[order], counts[order]
    goal = budget - budget % int(np.gcd.reduce(size[have > 0]))
    best = np.zeros_like(have)
    for most in RESTS:
        take = _filled(size, have, budget, most * int(size.max()))
        take += fit_rest(size, have - take, budget - int((take * size).sum()))
        if not best.any() or (take * size).sum() > (best * size).sum():
            best = take
        if (best * size).sum() == goal:
            break
    out = np.empty_like(best)
    out[order] = best
    return out


def _filled(size: np.ndarray, have: np.ndarray, budget: int, most: int) -> np.ndarray:
    """In proportion to the counts, but so that the rest of the budget is about most, or all of it where it is less."""
    total = int((size * have).sum())
    share = np.cumsum(have) * (max(0, budget - most) / total)
    take = np.minimum(np.diff(np.floor(share), prepend=0).astype(np.int64), have)
    take[size == 0] = have[size == 0]
    over = int((take * size).sum()) - budget
    for i in np.flatnonzero(size):
        if over <= 0:
            break
        less = min(int(take[i]), -(-over // int(size[i])))
        take[i] -= less
        over -= less * int(size[i])
    more = -over - 2 * most
    for i in np.flatnonzero(size):
        if more <= 0:
            break
        add = min(int(have[i] - take[i]), more // int(size[i]))
        take[i] += add
        more -= add * int(size[i])
    return take


def _lengths(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(tokens.token_counts(X.text_array(batch.column(2)), path))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "source", "n_tokens"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = own.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")
    return rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens"))


def _scale(shares: DataFrame, budget: float, whole: float) -> float:
    """Tokens for a unit of weight, so that sources that fall short are used whole and the others share the rest of budget."""
    scale, short = budget / whole, -1
    while True:
        lacking = F.col("total") <= F.col("weight") * scale
        got = shares.where("weight > 0").agg(
            F.count_if(lacking).alias("n"), F.sum(F.when(lacking, F.col("total"))).alias("used"), F.sum(F.when(~lacking, F.col("weight"))).alias("w")
        ).first()
        if got.w is None or got.n == short:
            return scale
        scale, short = max(scale, (budget - (got.used or 0)) / got.w), got.n


def mixture(docs: DataFrame, weights: DataFrame | None = None, budget: int | None = None, seed: int = SEED, vocabulary: str | None = None, least: float = 0.0) -> DataFrame:
    """doc_id, source and n_tokens of the documents chosen.

    weights(source, weight): the target shares, summed if a source repeats; sources without one, or with none above
    0, are left out. Without weights they are the shares of the tokens to the power TEMPER. budget: tokens in
    all, of which sources that fall short leave the rest to the others; without, the most that the weights allow with no
    document twice, but at least the share least of the tokens, for which scarce sources are used whole. A null source is a source of its own.
    Rows that share a doc_id are one document, whose length is their sum and whose source the smallest; rows with a
    null doc_id can't be chosen. A null text has no tokens. Equal hashes go by doc_id. No documents, no choice.
    """
    counted = saved(_lengths(docs, vocabulary or tokenizer_file(tokens.VOCABULARY)), "lengths")
    by_length = saved(counted.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "counts")
    totals = by_length.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("total"))
    if weights is None:
        shares = totals.withColumn("weight", F.pow(F.col("total").cast("double"), F.lit(TEMPER)))
    else:
        own = weights.where("weight > 0").groupBy(F.col("source").alias("for")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        shares = totals.join(own, F.col("source").eqNullSafe(F.col("for"))).drop("for")
    shares = saved(shares, "shares")
    top = shares.where("weight > 0").agg(F.sum("weight").alias("w"), F.min(F.col("total") / F.col("weight")).alias("most"), F.sum("total").alias("all")).first()
    whole = top.w or 1.0
    if budget is not None:
        scale = _scale(shares, budget, whole)
    else:
        scale = top.most or 0.0
        if least:
            scale = max(scale, _scale(shares, least * (top["all"] or 0), whole))
    budgets = shares.select(F.col("source").alias("for"), F.floor(F.col("weight") * scale + 1e-6).alias("budget"))
    joined = by_length.join(budgets, F.col("source").eqNullSafe(F.col("for"))).drop("for")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n_tokens")
        take = plan(rows.n_tokens.to_numpy(), rows.n.to_numpy(), int(rows.budget.iloc[0]), seed)
        return pd.DataFrame({"of": rows.source, "length": rows.n_tokens, "take": take})

    wanted = joined.groupBy("source").applyInPandas(fit, "of string, length bigint, take bigint").where("take > 0")
    nth = F.row_number().over(W.partitionBy("source", "n_tokens").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    match = F.col("source").eqNullSafe(F.col("of")) & (F.col("n_tokens") == F.col("length"))
    return counted.withColumn("nth", nth).join(wanted, match).where("nth <= take").select("doc_id", "source", "n_tokens")


def mixed(docs: DataFrame, weights: DataFrame | None = None, budget: int | None = None, seed: int = SEED, vocabulary: str | None = None, least: float = 0.0) -> DataFrame:
    """docs, all columns, with only the chosen documents; as mixture()."""
    chosen = saved(mixture(docs, weights, budget, seed, vocabulary, least).select("doc_id"), "chosen")
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    rest = saved(ids.join(chosen, "doc_id", "left_anti"), "rest")
    return without_ids(docs.where("doc_id IS NOT NULL"), rest)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents"), least=LEAST)
