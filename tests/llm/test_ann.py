import numpy as np
import pytest

from linescan.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, part int, home boolean, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, True, "x") for i, v in rows], SCHEMA)


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), A.unit(np.array([v for _, v in rows], np.float32))
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    return {i: set(ids[np.argsort(-s, kind="stable")[:k]].tolist()) for i, s in zip(ids.tolist(), near, strict=True)}


@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_recall(spark, spread):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(int(i), (centres[i % 20] + spread * rng.standard_normal(16)).tolist()) for i in range(2000)]
    got: dict[int, set] = {}
    for r in A.nearest(frame(spark, rows), 10, part_rows=200).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    want = brute(rows, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[i] & want[i]) / 10 for i in want]) >= 0.9


def test_parts_are_balanced_and_keep_neighbours():
    rng = np.random.default_rng(2)
    x = A.unit((rng.standard_normal((8, 12))[np.arange(800) % 8] * 4 + rng.standard_normal((800, 12))).astype(np.float32))
    graph = A.neighbour_graph(x, 5)
    part = A.balanced_parts(x, graph, 8, rng)
    assert np.bincount(part, minlength=8).max() <= 111 and (part[graph] == part[:, None]).mean() > 0.6


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, None), (6, [1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
        (9, [1.0, None]), (10, []), (2, [2.0, 0.0]), (3, [0.5, 1.0]),
    ]
    got = sorted((r.vec_id, r.rank, r.neighbour_id, round(r.similarity, 3)) for r in A.nearest(frame(spark, rows), 2).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (4, 1, 1, 0.0), (4, 2, 2, 0.0)]


def test_empty_single_and_equal(spark):
    assert A.nearest(frame(spark, [])).count() == 0 == A.nearest(frame(spark, [(1, None)])).count()
    assert A.nearest(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    rows = [(i, [1.0, 1.0, 1.0]) for i in range(300)]
    got = A.nearest(frame(spark, rows), 3, part_rows=50)
    assert got.count() == 900 and {r.neighbour_id for r in got.where("vec_id = 299").collect()} == {0, 1, 2}
