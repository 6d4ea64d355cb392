import random

import pytest

from linescan.llm import decontaminate as D
from tests.llm.cases import AWKWARD, LONG, frame, words


def brute(rows, items):
    """Every offset of every document and item, seed by seed."""
    out = []
    for i, text in rows:
        w = words(text)
        for j, item in items:
            v = words(item)
            for gap in range(-len(v), len(w)):
                hits = [
                    p for p in range(max(0, -gap), min(len(v), len(w) - gap) - D.SPAN + 1)
                    if any(all(v[p + q] == w[p + gap + q] for q in mask) for mask in D.MASKS)
                ]
                if hits:
                    a, z = hits[0], hits[-1] + D.SPAN
                    equal = sum(v[t] == w[t + gap] for t in range(a, z))
                    if z - a >= D.MIN_WORDS and equal >= D.MIN_SHARE * (z - a):
                        out.append((i, j, a + gap, a, z - a, equal))
    return sorted(out, key=repr)


def run(spark, rows, items, **options):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in D.overlaps(frame(spark, rows), bench, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(200)], k=rng.randint(5, 40)))) for i in range(12)]
    rows = []
    for i in range(60):
        w = rng.choices([f"w{k}" for k in range(200)], k=rng.randint(0, 50))
        if rng.random() < 0.6:
            v = [x if rng.random() > 0.12 else "changed" for x in words(rng.choice(items)[1])]
            at = rng.randint(0, len(w))
            w[at:at] = v
        rows.append((i, " ".join(w)))
    got = run(spark, rows, items)
    assert got == brute(rows, items) and len(got) > 15


@pytest.mark.parametrize("step", range(4, 12))
def test_regular_changes_are_tolerated(spark, step):
    item = [f"u{i}" for i in range(60)]
    rows = [(start, " ".join("changed" if i % step == start % step else w for i, w in enumerate(item))) for start in range(step)]
    got = run(spark, rows, [(1, " ".join(item))])
    assert {r[0] for r in got} == set(range(step)) and all(r[4] >= 40 for r in got)


def test_awkward(spark):
    items = [(1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18"), (None, LONG[:400]), (2, None), (3, "short item"), (1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18")]
    got = run(spark, [*AWKWARD, (12, items[0][1]), (12, items[0][1])], items)
    assert [r for r in got if r[0] == 12 and r[1] == 1] == [(12, 1, 0, 0, 14, 14)] * 4
    assert {r[0] for r in got} == {4, 5, 12} and (4, 1, 5, 0, 14, 14) in got and any(r[1] is None for r in got)


def test_empty(spark):
    assert run(spark, [], [(1, LONG)]) == [] == run(spark, AWKWARD, [])


@pytest.mark.parametrize("piece", [D.PIECE_BYTES, 200])
def test_without_overlaps(spark, monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE_BYTES", piece)
    rng = random.Random(2)
    items = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(20))) for i in range(10)]
    df = frame(spark, [*AWKWARD, *((20 + i, "before " + t + " after") for i, t in items)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = D.without_overlaps(df, bench)
    assert left.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(i) for i, _ in AWKWARD)
    assert len(D.overlaps(df, bench).collect()) == 10


def counting(same):
    """Whether some stretch is long and equal enough; a longer one has a half that is."""
    return any(sum(same[a : a + n]) >= D.MIN_SHARE * n for n in range(D.MIN_WORDS, 2 * D.MIN_WORDS) for a in range(len(same) - n + 1))


def test_changed_copies_of_short_items_are_found(spark):
    """Position by position, without masks."""
    rng = random.Random(3)
    items = [(i, " ".join(f"i{i}x{k}" for k in range(15 + i % 11))) for i in range(22)]
    rows = []
    for i in range(440):
        v = words(items[i % 22][1])
        for p in rng.sample(range(len(v)), rng.randint(0, len(v) // 4 + 1)):
            v[p] = "changed"
        rows.append((i, " ".join(["before"] * rng.randint(0, 3) + v + ["after"] * rng.randint(0, 3))))
    want = set()
    for i, text in rows:
        w, v = words(text), words(items[i % 22][1])
        for gap in range(-len(v), len(w)):
            if counting([v[p] == w[p + gap] for p in range(max(0, -gap), min(len(v), len(w) - gap))]):
                want.add((i, i % 22, gap))
    got, old = run(spark, rows, items, whole=True), brute(rows, items)
    assert set(old) <= set(got) and {(r[0], r[1], r[2] - r[3]) for r in got} == want and len(want) > len(old) + 50
    for i, j, at, a, n, equal in got:
        w, v = words(rows[i][1])[at : at + n], words(items[j][1])[a : a + n]
        assert len(w) == len(v) == n >= D.MIN_WORDS and sum(x == y for x, y in zip(w, v, strict=True)) == equal >= D.MIN_SHARE * n


@pytest.mark.parametrize("first,replaced,last", [(20, 15, 20), (15, 25, 19), (20, 40, 12), (14, 30, 5)])
def test_more_of_an_item_is_never_less(spark, first, replaced, last):
    """Passages that count stay overlaps, whatever lies between them."""
    item = [f"u{i}" for i in range(first + replaced + last)]
    text = " ".join(w if i < first or i >= first + replaced else "changed" for i, w in enumerate(item))
    got = run(spark, [(1, text), (2, " ".join(item[:first]))], [(1, " ".join(item))], whole=True)
    covered = {t for r in got if r[0] == 1 for t in range(r[3], r[3] + r[4])}
    want = {*range(first), *(range(first + replaced, len(item)) if last >= D.MIN_WORDS else ())}
    assert {r[0] for r in got} == {1, 2} and want <= covered
    docs = frame(spark, [(1, text), (3, "another text")])
    assert [r.doc_id for r in D.without_overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), whole=True).collect()] == [3]


def test_repeated_words_and_items_are_bounded(spark):
    """20,000 equal words against an item of 500: every offset once; repeated items each have their rows."""
    docs = frame(spark, [(1, "a " * 20000)])
    bench = spark.createDataFrame([(7, "a " * 500)], "item_id long, text string")
    assert D.overlaps(docs, bench).count() == 20000 + 500 - 2 * 12 + 1
    item = " ".join(f"i{k}" for k in range(20))
    bench = spark.createDataFrame([(7, item)] * 3 + [(None, item)], "item_id long, text string")
    assert sorted(str(r.item_id) for r in D.overlaps(frame(spark, [(1, item)]), bench).collect()) == ["7", "7", "7", "None"]
