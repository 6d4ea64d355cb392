import math
import random
import time
import tracemalloc
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from linescan.llm import _spark as S
from linescan.llm import _text as X
from linescan.llm import ngram_join as J
from tests.llm.cases import AWKWARD, LONG, frame, words


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, threshold):
    sets = [(i, grams(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if i != j and a and len(a & b) >= threshold * len(a | b) - 1e-9:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    groups = {}
    for i in root:
        groups.setdefault(find(i), set()).add(i)
    return {tuple(sorted(g)) for g in groups.values() if len(g) > 1}


def run(spark, rows, n=J.N, threshold=J.THRESHOLD):
    return {tuple(r.doc_ids) for r in J.groups(frame(spark, rows), n, threshold).collect()}


def corpus(rng, count):
    rows, texts = [], []
    for i in range(count):
        if texts and rng.random() < 0.6:
            w = list(rng.choice(texts))
            for _ in range(rng.randint(0, len(w) // 8 + 1)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = w[: rng.randint(1, len(w))]
        else:
            w = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 3, 5, 20, 60, 200]))]
        texts.append(w)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,n,threshold", [(1, 3, 0.7), (2, 2, 0.65), (3, 1, 0.85), (4, 3, 0.5)])
def test_equals_brute_force(spark, seed, n, threshold):
    rows = corpus(random.Random(seed), 150)
    want, got = brute(rows, n, threshold), run(spark, rows, n, threshold)
    pairs = lambda groups: {p for g in groups for p in combinations(g, 2)}
    assert pairs(got) == pairs(want)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_similar_sets_share_a_signature(threshold):
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 4, 7, 8, 15, 16, 40, 70, 127, 200):
        for _ in range(20):
            x = rng.integers(0, 2**64, size, dtype=np.uint64)
            gone = rng.integers(0, size // 2 + 1)
            y = np.concatenate((x[gone:], rng.integers(0, 2**64, rng.integers(0, size // 2 + 1), dtype=np.uint64)))
            x, y = np.unique(x), np.unique(y)
            if len(np.intersect1d(x, y)) < threshold * len(np.union1d(x, y)) or not len(y):
                continue
            level = rng.integers(0, 9, 1 << J.COUNT_BITS).astype(np.uint8)  # any order will do
            row, sign = J._signatures(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]), threshold, level)
            assert set(sign[row == 0].tolist()) & set(sign[row == 1].tolist()), (size, len(x), len(y))


def degrees(rows, n=J.N, threshold=J.THRESHOLD):
    """Of every id: its group's smallest, and with how many others it is similar in any of its texts."""
    near = {i: set() for i, _ in rows if i is not None}
    sets = [(i, grams(t, n)) for i, t in rows if i is not None]
    for (i, a), (j, b) in combinations(sets, 2):
        if i != j and a and len(a & b) >= threshold * len(a | b) - 1e-9:
            near[i].add(j)
            near[j].add(i)
    least = {i: g[0] for g in brute(rows, n, threshold) for i in g}
    return {(i, least.get(i, i), len(s)) for i, s in near.items()}


def counted(spark, rows, n=J.N, threshold=J.THRESHOLD):
    found = [(r.doc_id, r.group_id, r.n_links) for r in J.links(frame(spark, rows), n, threshold).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed,n,threshold", [(21, 2, 0.65), (22, 3, 0.5)])
def test_every_link_counts(spark, seed, n, threshold):
    """Groups of near copies that aren't all alike, with equal texts, and ids of several texts; a group alone doesn't tell its links."""
    rows = corpus(random.Random(seed), 150)
    rows += [(1000 + i, t) for i, t in rows[::7]] + [(i, t) for (i, _), (_, t) in zip(rows[::11], rows[5::11])]
    want = degrees(rows, n, threshold)
    assert counted(spark, rows, n, threshold) == want
    size = {g: sum(x[1] == g for x in want) for _, g, _ in want}
    assert any(0 < links < size[g] - 1 for _, g, links in want)


def test_links_of_awkward_texts_and_of_none(spark):
    assert counted(spark, AWKWARD) == degrees(AWKWARD) and counted(spark, []) == set()
    rows = [(1, "a b c"), (2, "a b c"), (2, "x y z u v w"), (3, "x y z u v w"), (4, "a b c"), (5, ""), (5, "q r s"), (6, ""), (6, "q r s t")]
    assert counted(spark, rows) == degrees(rows)


def test_links_of_large_groups_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(23)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 25)):
            w[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    want = degrees(rows)
    assert counted(spark, rows) == want and any(0 < links < 250 for *_, links in want)
    monkeypatch.setattr(J, "GROUP_DOCS", 30)
    assert counted(spark, rows) == want


def test_sketches_leave_out_no_similar_pair():
    """Of pairs just at the threshold less than 1 of 10**9 has sketches that differ by more; of 6 standard deviations, 1 of 10**8 had."""
    size = np.array([1000])
    a = np.zeros((1, 3), np.uint64)
    expected = J.SKETCH * (1 - J.THRESHOLD) / 2
    chance = [math.comb(J.SKETCH, k) * (p := (1 - J.THRESHOLD) / 2) ** k * (1 - p) ** (J.SKETCH - k) for k in range(J.SKETCH + 1)]
    for bits in range(int(expected), J.SKETCH + 1):
        b = np.packbits(np.arange(J.SKETCH) < bits).view(np.uint64)[None]
        if not J._compared(a, b, size, size, J.THRESHOLD, False)[0][0]:
            assert sum(chance[bits:]) < 1e-9
            break


def test_common_counts_rare_and_frequent_features():
    rng = np.random.default_rng(24)
    sets = [np.unique(np.concatenate((rng.choice(40, 20), 1000 + rng.choice(3000, 30)))).astype(np.uint64) for _ in range(90)]
    first = np.cumsum([0, *map(len, sets)])
    a, b = np.arange(0, 50), np.arange(50, 90)
    for left, right in ((a, b), (np.arange(90), np.arange(90))):
        got = J._common(np.concatenate(sets), first, left, right)
        want = np.array([[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left])
        assert (got == want)[left[:, None] != right].all()


def test_awkward(spark):
    assert run(spark, AWKWARD) == brute(AWKWARD, J.N, J.THRESHOLD) == {(4, 5)}


def test_large_group_and_ties(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j + 1 :])) for i in range(1, 400) for j in [rng.randrange(120)]]
    assert run(spark, rows) == {tuple(range(1, 400))}


def test_crowded_signatures(spark):
    """Every word pair is in some 160 unlike documents, after which come the copies."""
    rng = random.Random(6)
    texts = [rng.choices([f"v{k}" for k in range(12)], k=14) for _ in range(1500)]
    for i in range(1200, 1500):
        w = list(texts[i])
        w[rng.randrange(1, 13)] = "changed"
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want = brute(rows, J.N, J.THRESHOLD)
    assert run(spark, rows) == want and sum(map(len, want)) >= 600


def linked(rows, n=J.N, threshold=J.THRESHOLD):
    """brute(), by an inverted index, since there are many."""
    sets = [grams(t, n) for _, t in rows]
    by = {}
    for i, own in enumerate(sets):
        for g in own:
            by.setdefault(g, []).append(i)
    edges = set()
    for i, own in enumerate(sets):
        common = {}
        for g in own:
            for j in by[g]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        edges |= {(i, j) for j, c in common.items() if c >= threshold * (len(own) + len(sets[j]) - c) - 1e-9}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in edges:
        x, y = sorted((find(i), find(j)))
        root[y] = x
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {tuple(sorted(g)) for g in groups.values() if len(g) > 1}


def test_very_many_short_texts(spark):
    """20,000 texts of 4 words, and each without its last."""
    rng = random.Random(11)
    texts = [[f"v{rng.randrange(400)}" for _ in range(4)] for _ in range(20000)]
    rows = list(enumerate(" ".join(w) for w in texts + [w[:3] for w in texts]))
    assert run(spark, rows) == linked(rows)


@pytest.mark.parametrize("sure", [J.SURE, 2.0])
def test_chains(spark, sure):
    """a ~ b ~ c where a isn't like c; also where pairs are taken to be similar that aren't."""
    rng, rows = random.Random(12), []
    for c in range(300):
        base = [f"c{c}w{i}" for i in range(rng.randint(60, 400))]
        cut = int(len(base) * 0.17)
        b = base[cut:] + [f"c{c}x{i}" for i in range(cut)]
        z = b[2 * cut :] + [f"c{c}y{i}" for i in range(cut + cut // 3)]
        rows += [(3 * c, " ".join(base)), (3 * c + 1, " ".join(b)), (3 * c + 2, " ".join(z))]
    order = list(range(900))
    rng.shuffle(order)
    rows = [(order[i], t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for r in J.linked(docs, sure=sure).collect():
        groups.setdefault(r.root, {r.root}).add(r.node)
    want = linked(rows)
    assert {tuple(sorted(g)) for g in groups.values()} == want and len(want) > 250


def test_what_was_united_wrongly_is_compared_again():
    """All that is near is taken to be similar: the second pass must have every pair of those documents."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)) for _ in range(40)]
    sets = [np.unique(np.concatenate((sets[i % 40][: 60 - i // 8], rng.integers(0, 2**64, i // 8, dtype=np.uint64)))) for i in range(200)]
    gram, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    row, sign = J._signatures(gram, first, J.THRESHOLD, np.zeros(1 << J.COUNT_BITS, np.uint8))
    order = np.lexsort((sign, row))
    row, sign = row[order], sign[order]
    own, count = np.unique(row, return_counts=True)

    def held():
        parts = own.astype(np.int64), np.diff(first)[own].astype(np.int32), count.astype(np.uint8), J._sketches(gram, first)[own]
        return [[*(x.tobytes() for x in parts), (sign & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (sign >> np.uint64(32)).astype(np.uint16).tobytes()]]

    a, b, united = J._bucket_pairs(held(), J.THRESHOLD, False, 2.0)
    alone = {(min(x, y), max(x, y)) for x, y, u in zip(a.tolist(), b.tolist(), united.tolist(), strict=True)}
    x, y, _ = J._pairs_with(held(), J.THRESHOLD, False, np.full(1, -1, np.int64).view(np.uint64))
    every = set(zip(x.tolist(), y.tolist(), strict=True))
    similar = {(i, j) for i in range(200) for j in range(i + 1, 200) if len(np.intersect1d(sets[i], sets[j])) >= J.THRESHOLD * len(np.union1d(sets[i], sets[j]))}
    assert similar <= every and alone <= every and len(similar) > 80
    root = {i: i for i in range(200)}
    for i, j in sorted(alone):
        if (i, j) in similar:
            root = {k: root[i] if r == root[j] else r for k, r in root.items()}
    assert all(root[i] == root[j] for i, j in similar)


def test_exact(spark):
    rows = corpus(random.Random(5), 120)
    got = {tuple(r.doc_ids) for r in J.groups(frame(spark, rows), exact=True).collect()}
    assert got == brute(rows, J.N, J.THRESHOLD)


def test_equal_texts_of_ids_with_several_texts(spark):
    rows = [(1, "a b c"), (2, "a b c"), (2, "x y z u v w"), (3, "x y z u v w"), (4, "a b c"), (5, "!!!"), (6, "!!!")]
    assert run(spark, rows) == {(1, 2, 3, 4)}


def test_repeated_ids_and_short_texts(spark):
    rows = [(1, "a"), (2, "A.!"), (2, "other words than those"), (3, "a b"), (4, "a b"), (5, "b a"), (None, "a b")]
    assert run(spark, rows) == {(1, 2), (3, 4)}


def test_empty(spark):
    assert run(spark, []) == set() and run(spark, [(1, None), (2, None)]) == set()
    assert J.without_copies(frame(spark, [])).count() == 0


def test_without_copies_keeps_columns_and_firsts(spark):
    df = frame(spark, [*AWKWARD, (11, LONG + " more")])
    left = J.without_copies(df)
    assert left.columns == df.columns
    want = sorted((str(i), t or "") for i, t in AWKWARD if i != 5)
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == want


def test_sets_and_sketches():
    texts = X.text_array(pa.array(["a b c d", "", "a b c d", "x y", None]))
    gram, first = J._sets(texts, 3)
    assert np.diff(first).tolist() == [2, 0, 2, 1, 0]
    sketch = J._sketches(gram, first)
    assert (sketch[0] == sketch[2]).all() and not sketch[1].any()


def test_closed_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in J.closed(pairs, local=0).collect()}
    assert got == {r.node: r.root for r in J.closed(pairs).collect()} == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_a_task_holds_few_texts_at_once(monkeypatch):
    """With 2 MB of text at once the arrays of a worker took 93 MB here, and two of them and their JVM more than an executor has."""
    rng = random.Random(31)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(400)) for _ in range(3000)]
    batch = pa.record_batch([pa.array(range(3000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(X, "_pow", (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    tracemalloc.start()
    for _ in J._counted(J.N, J.THRESHOLD, None)(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_packed_rows_hold_what_every_text_signs():
    """However many texts are packed at once; those of several batches too."""
    rows = corpus(random.Random(32), 300)
    level = np.zeros(1 << J.COUNT_BITS, np.uint8)
    batches = [pa.record_batch([pa.array([i for i, _ in r], pa.int64()), pa.array([t for _, t in r])], ["doc_id", "text"]) for r in (rows[:120], rows[120:])]
    gram, first = J._sets(X.text_array(pa.array([t for _, t in rows])), J.N)
    row, sign = J._signatures(gram, first, J.THRESHOLD, level)
    want = {(rows[r][0], s & (1 << 48) - 1) for r, s in zip(row.tolist(), X.mix(sign).tolist(), strict=True)}
    for most in (1, J.PACKED_ROWS):
        got = set()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(J, "PACKED_ROWS", most)
            for out in J._signed(J.N, J.THRESHOLD, 5, SimpleNamespace(value=level))(iter(batches)):
                for _, docs, sizes, counts, sketches, low, high in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    docs, counts = np.frombuffer(docs, np.int64), np.frombuffer(counts, np.uint8)
                    assert np.array_equal(np.frombuffer(sizes, np.int32), np.diff(first)[docs])
                    assert np.array_equal(np.frombuffer(sketches, np.uint64).reshape(-1, J.SKETCH // 64), J._sketches(gram, first)[docs])
                    signs = np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)
                    got |= set(zip(np.repeat(docs, counts).tolist(), signs.tolist(), strict=True))
        assert got == want


def test_jobs_send_few_rows_at_once_and_settings_come_back(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    most = lambda: max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect())
    before = {k: spark.conf.get(k, None) for k in (S.BATCH_ROWS, S.CLEAN_UP)}
    with pytest.raises(ZeroDivisionError), S.sparing(spark, 100):
        assert most() == 100
        with S.sparing(spark, 200):
            assert most() == 100
        raise ZeroDivisionError
    assert {k: spark.conf.get(k, None) for k in before} == before and most() == 5000


def test_what_was_shuffled_is_removed(spark):
    """The shuffles of one job lay beside those of the next ones until the driver happened to collect its garbage."""

    def shuffles():
        names = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {x for x in names if "/shuffle_" in x}

    docs = frame(spark, corpus(random.Random(33), 100))
    before = shuffles()
    J.links(docs)
    for _ in range(20):
        if not (left := shuffles() - before):
            break
        time.sleep(0.5)
    assert not left


def test_closed_by_joins_without_old_shuffles(spark):
    with S.sparing(spark, J.ROWS):
        pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long").repartition(3)
        got = {r.node: r.root for r in J.closed(pairs, local=0).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 91: 90}
