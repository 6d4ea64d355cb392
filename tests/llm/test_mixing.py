import itertools

import numpy as np
import pytest

from linescan.llm import mixing as M
from linescan.llm import tokens as T
from linescan.llm._spark import tokenizer_file
from tests.llm.cases import AWKWARD, LONG, frame


def best_sum(lengths, counts, budget):
    sums = {sum(x * n for x, n in zip(xs, lengths, strict=True)) for xs in itertools.product(*[range(c + 1) for c in counts])}
    return max(s for s in sums if s <= budget)


def test_plans_against_all_choices():
    rng = np.random.default_rng(0)
    for _ in range(300):
        k = rng.integers(1, 5)
        lengths, counts, budget = rng.choice(np.arange(12), k, replace=False), rng.integers(0, 4, k), int(rng.integers(0, 40))
        want = best_sum(lengths.tolist(), counts.tolist(), budget)
        fitted, planned = M.fit_rest(lengths, counts, budget), M.plan(lengths, counts, budget, 5)
        for take in (fitted, planned):
            assert (take <= counts).all() and (take >= 0).all() and (take * lengths).sum() == want


def test_large_plans_are_exact_and_in_proportion():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 30000, 5000))
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.2, 0.5, 0.9):
        take = M.plan(lengths, counts, int(total * share), 7)
        assert (take * lengths).sum() == int(total * share)
        half = lengths > np.median(lengths)
        assert abs((take[half] * lengths[half]).sum() / (counts[half] * lengths[half]).sum() - share) < 0.02
    assert (M.plan(lengths, counts, total, 7) == counts).all() and M.plan(lengths, counts, 0, 7).sum() == 0


def test_a_budget_no_length_divides():
    assert (M.plan(np.array([4, 6]), np.array([50, 50]), 101, 1) * [4, 6]).sum() == 100


def documents(spark, n=400):
    rng = np.random.default_rng(3)
    return frame(spark, [(i, " ".join(["word"] * int(rng.integers(1, 60))), f"s{i % 4}") for i in range(n)])


def sums(rows):
    out = {}
    for r in rows:
        out[r.source] = out.get(r.source, 0) + r.n_tokens
    return out


def test_weights_and_budget_are_met(spark):
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 2.0), ("s2", 0.5), ("s2", 0.5), ("none", 1.0), ("s3", 0.0)], "source string, weight double")
    df = documents(spark)
    rows = M.mixture(df, weights, 4000).collect()
    assert sums(rows) == {"s0": 1000, "s1": 2000, "s2": 1000}
    path = tokenizer_file(T.VOCABULARY)
    text = {r.doc_id: r.text for r in df.collect()}
    assert all(r.n_tokens == len(T.encoding(path).encode_ordinary(text[r.doc_id])) for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in M.mixture(df, weights, 4000).collect()}
    assert {r.doc_id for r in rows} != {r.doc_id for r in M.mixture(df, weights, 4000, seed=5).collect()}
    full = M.mixed(df, weights, 4000)
    assert full.columns == df.columns and sorted(r.doc_id for r in full.collect()) == sorted(r.doc_id for r in rows)


def test_without_weights_the_scarcest_source_is_used_up(spark):
    df = frame(spark, [(i, "word " * 10, "big" if i < 90 else "small") for i in range(100)])
    rows = M.mixture(df).collect()
    got = sums(rows)
    big, small = 90 * 11, 10 * 11
    assert got["small"] == small
    ideal = small * (big / small) ** M.TEMPER
    assert ideal - 11 <= got["big"] <= ideal


def test_a_scarce_source_does_not_shrink_the_others(spark):
    df = frame(spark, [(i, "word " * 10, "big" if i < 60 else "other") for i in range(100)] + [(200, "x", None)])
    got = sums(M.mixture(df, least=M.LEAST).collect())
    assert got[None] == 1 and M.LEAST * 1101 - 22 <= sum(got.values()) <= M.LEAST * 1101
    assert got["big"] / got["other"] == pytest.approx((60 / 40) ** M.TEMPER, rel=0.05)
    weights = spark.createDataFrame([("big", 1.0), ("other", 1.0)], "source string, weight double")
    assert sums(M.mixture(df, weights, 1000).collect()) == {"big": 550, "other": 440}


def test_awkward(spark):
    df = frame(spark, [*AWKWARD, (30, "null source", None), (31, "a b", "t"), (31, "c d e", "s")])
    rows = M.mixture(df, None, 10**9).collect()
    assert sorted(r.doc_id for r in rows) == sorted({i for i, *_ in AWKWARD if i is not None} | {30, 31})
    one = {r.doc_id: r for r in rows}
    assert one[31].source == "s" and one[31].n_tokens == 5 and one[30].source is None and one[1].n_tokens == 0 and one[6].n_tokens == 2
    assert one[4].n_tokens == len(T.encoding(tokenizer_file(T.VOCABULARY)).encode_ordinary(LONG))
    assert M.mixed(df, None, 10**9).count() == len([1 for i, *_ in AWKWARD if i is not None]) + 3


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "x")]])
def test_empty(spark, rows):
    df = frame(spark, rows)
    assert M.mixture(df).count() == M.mixed(df).count() == len([1 for i, _ in rows if i is not None])
