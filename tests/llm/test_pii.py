import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from linescan.llm import _text as X
from linescan.llm import pii as P
from tests.llm.cases import AWKWARD, LONG, frame


@pytest.fixture(scope="module")
def field():
    return P.trained()


def test_held_out_accuracy(field):
    table = P.labelled_table(400, seed=99)
    found = P.decoded(field, [w for w, _ in table])
    pairs = [(a, b) for (_, y), o in zip(table, found, strict=True) for a, b in zip(y, o, strict=True)]
    assert np.mean([a == b for a, b in pairs]) > 0.995
    private = [(a, b) for a, b in pairs if a != "other" or b != "other"]
    assert np.mean([a == b for a, b in private]) > 0.98


def test_viterbi_equals_brute_force(field):
    rng = np.random.default_rng(1)
    scores, length = rng.standard_normal((20, 5, 3)), rng.integers(1, 6, 20)
    moves, first, last = rng.standard_normal((3, 3)), rng.standard_normal((20, 3)), rng.standard_normal((20, 3))
    got = P.viterbi(scores, length, moves, first, last)
    for n in range(20):
        def score(path, n=n):
            return first[n, path[0]] + last[n, path[-1]] + sum(scores[n, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product(range(3), repeat=int(length[n])), key=score)
        assert tuple(got[n, : length[n]]) == best


def test_skipping_quiet_words_changes_nothing(field):
    assert field.certain
    texts = [" ".join(w) for w, _ in P.labelled_table(200, seed=5)] + ["plain words only", "", LONG[:3000], "token and key and secret here", "7"]
    every = P.Field(field.weights, field.moves, field.start, False)
    array = X.text_array(pa.array([t + " and so on it goes for a while " + u for t, u in zip(texts, reversed(texts), strict=True)]))
    assert P._chunk(field, array) == P._chunk(every, array)


def run(spark, rows):
    return sorted((tuple(r) for r in P.private_data(frame(spark, rows)).collect()), key=repr)


def test_kinds_and_places(spark):
    text = "Écrire à jean.7@mail.example.com, tel +1 (743) 555-3824!! ip 10.0.0.255. card 4465758382889437### token = \"11acdfb36bb72224148e6160f674b4be45601bff\" version 2.0. in 1999"
    found = run(spark, [(1, text)])
    assert {(r[3], r[4]) for r in found} == {
        ("email", "jean.7@mail.example.com"), ("phone", "+1 (743) 555-3824"), ("ip", "10.0.0.255"), ("card", "4465758382889437"),
        ("secret", "11acdfb36bb72224148e6160f674b4be45601bff"),
    }
    assert all(text[r[1] : r[1] + r[2]] == r[4] for r in found)


def test_awkward(spark):
    far = LONG.replace("w", "z") and "word " * 30000 + "a.b1@mail2.example.org"
    rows = [*AWKWARD, (None, "4465758382889437"), (20, far), (21, "10.1.2.3"), (21, "10.1.2.3")]
    got = run(spark, rows)
    assert (None, 0, 16, "card", "4465758382889437") in got
    assert (20, 150000, 22, "email", "a.b1@mail2.example.org") in got
    assert got.count((21, 0, 8, "ip", "10.1.2.3")) == 2
    assert run(spark, []) == []


def test_whole_table_against_patterns(spark):
    """In the made-up documents, all kinds can be told by patterns too."""
    folder = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.value) for r in P.op6_pii_crf(spark, folder).collect()}
    kinds = [r"[\w.]+@[\w.]+\.[a-z]{2,}", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)", r"(?<!\d)\d{16}(?!\d)", r"\b[0-9a-fA-F]{32,}\b", r"\+\d+ \(\d{3}\) \d{3}-\d{4}"]
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {(r.doc_id, m) for r in rows for k in kinds for m in re.findall(k, r.text)}
    assert len(want & got) >= 0.98 * len(want) and len(want & got) >= 0.98 * len(got)
