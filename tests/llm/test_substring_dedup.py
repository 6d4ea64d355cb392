import random
from collections import Counter

import pytest

from linescan.llm import substring_dedup as D
from tests.llm.cases import AWKWARD, LONG, frame, words


def brute(rows, k):
    """Stretches by dictionaries of whole windows."""
    count, first = Counter(), {}
    key = lambda i: (i is not None, i or 0)
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - k + 1):
            window = tuple(w[p : p + k])
            count[window] += 1
            first[window] = min(first.get(window, (key(i), p)), (key(i), p))
    out = set()
    for i in {i for i, _ in rows}:
        hit = {}
        for j, text in rows:
            w = words(text)
            if j == i:
                for p in range(len(w) - k + 1):
                    window = tuple(w[p : p + k])
                    if count[window] > 1:
                        hit[p] = max(hit.get(p, 0), count[window])
        at = sorted(hit)
        for n, p in enumerate(at):
            if n == 0 or at[n - 1] < p - 1:
                start = p
            if n == len(at) - 1 or at[n + 1] > p + 1:
                out.add((i, start, p + k, p - start + 1, max(hit[q] for q in range(start, p + 1))))
    return out


def run(spark, rows, k=5, m=2):
    found = D.repeated_spans(frame(spark, rows), k, m)
    return {(r.doc_id, r.start_word, r.end_word, r.windows, r.max_copies) for r in found.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = " ".join(rng.choices("abcdefgh", k=12))
    rows = [(i, " ".join(rng.choices("abcd" * (seed + 1) + "efghijkl", k=rng.randint(0, 60))) + rng.choice(["", f" {passage} "])) for i in range(40)]
    assert run(spark, rows) == brute(rows, 5)


def test_awkward(spark):
    assert run(spark, AWKWARD) == brute(AWKWARD, 5)


def test_null_id_repeats(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f")]
    assert run(spark, rows) == {(None, 0, 6, 2, 2), (1, 0, 6, 2, 2)}
    later = {r.doc_id: r.later_windows for r in D.repeated_spans(frame(spark, rows), 5, 2).collect()}
    assert later == {None: 0, 1: 2}


def test_repeated_rows_and_one_word_texts(spark):
    rows = [(1, "a " * 30), (1, "a " * 30), (2, "A, a; A. " * 3)]
    assert run(spark, rows) == {(1, 0, 30, 26, 57), (2, 0, 9, 5, 57)}


def test_empty(spark):
    assert run(spark, []) == set() and run(spark, [(1, "a b")]) == set()


def test_long_text_repeats_in_full(spark):
    assert run(spark, [(1, LONG), (2, "x " + LONG)], 50, 8) == {(1, 0, 20000, 19951, 2), (2, 1, 20001, 19951, 2)}


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    import numpy as np

    parts = [b"a b c ", b"a d c ", b"a b c "]
    real = D.X.Words.hashes
    monkeypatch.setattr(D.X.Words, "hashes", lambda self: np.where(np.isin(self.data[self.start], [98, 100]), np.uint64(7), real(self)))
    out = D._repeats(np.array([1, 2, 3]), np.zeros(3, np.int32), np.ones(3, np.int32), parts, 3)
    assert sorted(out["doc_id"].to_pylist()) == [1, 3]


def test_wrong_parameters(spark):
    with pytest.raises(ValueError):
        D.repeated_spans(frame(spark, []), 5, 6)
