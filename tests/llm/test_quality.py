import random

import pytest
from pyspark.sql import functions as F

from linescan.llm import quality as Q
from tests.llm.cases import AWKWARD, frame


def made(seed, n):
    """Documents in the open, junk, and documents with a bad word."""
    rng = random.Random(seed)
    good = [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(good).capitalize() if rng.random() < 0.1 else rng.choice(good) for _ in range(rng.randint(20, 200))]
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        if kind == "junk":
            w = [x.upper() + rng.choice(["!!", "***", "%%"]) for x in w]
        if kind == "toxic":
            w[rng.randrange(len(w))] = rng.choice(["vile", "foul"])
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if kind == "junk" else 1, 1 if kind == "toxic" else 0))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def kept(spark):
    rows, labels = made(1, 900)
    given = label_frame(spark, labels[:500])
    ids = {r.doc_id for r in Q.kept(frame(spark, rows), given).collect()}
    return ids, labels


def test_held_out_documents(kept):
    ids, labels = kept
    held = labels[500:]
    good = [i in ids for i, q, t in held if q and not t]
    bad = [i not in ids for i, q, t in held if not q or t]
    assert sum(good) >= 0.97 * len(good) and sum(bad) >= 0.97 * len(bad)


def test_filtered_equals_kept(spark):
    rows, labels = made(2, 300)
    df, given = frame(spark, rows), label_frame(spark, labels[:200])
    left = Q.filtered(df, given)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in Q.kept(df, given).collect()}


def test_threshold_is_a_quantile_of_labelled_good_scores(spark):
    rows, labels = made(3, 400)
    df, given = frame(spark, rows), label_frame(spark, labels)
    own = Q.with_long_id(df, "doc_id", "text")
    scores = Q.scored(own, Q.fit(own, given)).toPandas().set_index("doc_id").score
    good = sorted(scores[i] for i, q, t in labels if q and not t)
    least = Q.cut(spark.createDataFrame(scores.reset_index()), given, 0.1)
    assert least == good[max(0, -(-len(good) // 10) - 1)]


def test_preferred_scores_higher(spark):
    rows, labels = made(4, 300)
    own = Q.with_long_id(frame(spark, rows), "doc_id", "text")
    score = {r.doc_id: r.score for r in Q.scored(own, Q.fit(own, label_frame(spark, labels))).collect()}
    good, bad = [score[i] for i, q, t in labels if q and not t], [score[i] for i, q, t in labels if not q or t]
    assert sum(a > b for a in good for b in bad) >= 0.98 * len(good) * len(bad)


def test_awkward(spark):
    rows, labels = made(5, 200)
    odd = [(None, 1, 0), (1000, None, None), (0, 1, 0), (0, 0, 0), (5000, 1, 0), (7, None, 1)]
    given = label_frame(spark, labels + odd)
    extra = [(i if i is None else i + 10_000, t) for i, t in AWKWARD]
    df = frame(spark, rows + extra)
    out = Q.kept(df, given)
    assert out.columns == ["doc_id", "score"]
    got = out.groupBy("doc_id").agg(F.countDistinct("score").alias("n"), F.count("*").alias("c")).collect()
    twice = [r for r in got if r.doc_id == 10_006]
    assert all(r.n == 1 and r.c == 2 for r in twice)
    assert Q.filtered(df, given).count() == out.count()


def test_no_labels_keep_all(spark):
    df = frame(spark, AWKWARD)
    for labels in ([], [(4, 1, 0)], [(6, 0, 0)]):
        assert Q.kept(df, label_frame(spark, labels)).count() == len(AWKWARD) == Q.filtered(df, label_frame(spark, labels)).count()


def test_empty(spark):
    assert Q.kept(frame(spark, []), label_frame(spark, [])).count() == 0
    assert Q.filtered(frame(spark, []), label_frame(spark, [(1, 1, 0), (2, 0, 0)])).count() == 0


def test_planted_labels_of_the_table(spark):
    """Documents labelled bad go, those labelled good stay."""
    folder = "/root/testdata/sf0.01"
    ids = {r.doc_id for r in Q.op8_quality_classifier(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [r.doc_id in ids for r in labels if r.quality and not r.toxic]
    bad = [r.doc_id not in ids for r in labels if not r.quality or r.toxic]
    assert sum(good) >= 0.99 * len(good) and sum(bad) >= 0.95 * len(bad)
