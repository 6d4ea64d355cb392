"""Benchmark decontamination by spaced seeds.

A seed is a window of SPAN words of which a fixed mask ignores some, so that texts meet although words were
exchanged. The masked windows of the test items are joined with those of the training documents. The hits of a
document and an item with one offset between them span an overlap, which counts if it is long enough and enough
of its words, position by position, are equal.

No choice of masks meets every such overlap, so what they miss is sought by runs of RUN equal words in a row. A
stretch of n words with at most n / 4 unequal ones has n / 4 + 1 runs at most, and so, from 9 words on, one of 3 words at
least: no stretch that is long and equal enough is without a run. Around a run the words are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import read, with_long_id

SPAN = 12
#: Positions of a window that a seed compares. The first fits 8 equal words in a row, the others texts of which every
#: 4th, 5th, or 6th to 8th word was changed.
MASKS = (
    (0, 1, 2, 3, 4, 5, 6, 7),
    (0, 1, 2, 4, 5, 6, 8, 9),
    (0, 1, 2, 3, 5, 6, 7, 8),
    (0, 1, 2, 3, 4, 6, 7, 8),
)
MIN_WORDS = 12
MIN_SHARE = 0.75
RUN = 3
#: A shortest stretch that counts has fewer than 2 * MIN_WORDS words, and a run of MIN_WORDS is one: seen from the
#: first word of a run, the words of a stretch that has some of the run lie this far before and after.
BEFORE, AFTER = 2 * MIN_WORDS, 3 * MIN_WORDS
BLOCK = 1 << 20  # of pairs of runs that are compared at once
PIECE_BYTES = 8 << 20  # of test texts that a task holds at once
FILTER_BITS = 22
CHUNK = 2 << 20


@dataclass
class Items:
    """The seeds of test items, sorted by key, and the hashes of their words."""

    ids: list[int | None]
    times: np.ndarray  # how often each item is there
    words: np.ndarray
    first: np.ndarray
    key: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    run_key: np.ndarray
    run_at: np.ndarray
    run_filter: np.ndarray


def _filter(key: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return seen


def _runs(words: X.Words, h: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The keys and first words of all runs of RUN words of a text; within: a filter that keys have to pass."""
    key = X.grams(h, RUN)
    at = np.arange(len(key)) if within is None else np.flatnonzero(within[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    at = at[at + RUN <= words.first[words.doc[at] + 1]]
    return key[at], at


def _keys(h: np.ndarray, mask: int) -> np.ndarray:
    n = len(h) - SPAN + 1
    out = np.full(n, X.COEF[100 + mask])
    for p in MASKS[mask]:
        out += h[p : p + n] * X.COEF[p + SPAN * mask]
    return out


def _items(rows: list) -> Items:
    words = X.split_words(X.text_array(pa.array([r.text for r in rows], pa.string())))
    h = words.hashes()
    key, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(h) >= SPAN:
        at = np.flatnonzero(np.arange(len(h) - SPAN + 1) + SPAN <= words.first[words.doc[: len(h) - SPAN + 1] + 1])
        for mask in range(len(MASKS)):
            key.append(_keys(h, mask)[at])
            item.append(words.doc[at])
            place.append(at - words.first[words.doc[at]])
    key, item, place = map(np.concatenate, (key, item, place))
    order = np.argsort(key, kind="stable")
    run_key, run_at = _runs(words, h)
    by = np.argsort(run_key, kind="stable")
    return Items([r.item_id for r in rows], np.array([r.times for r in rows], np.int64), h, words.first, key[order], item[order], place[order], _filter(key), run_key[by], run_at[by], _filter(run_key))


def _overlaps(texts: pa.Array, items: Items, whole: bool) -> tuple[np.ndarray, ...]:
    """Row, item, first word in the text and in the item, words and equal words of each overlap that counts."""
    words = X.split_words(texts)
    h = words.hashes()
    if len(h) < SPAN or not len(items.key):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    spans = _masked(words, h, items)
    size, equal = spans[4:]
    good = (size >= MIN_WORDS) & (equal >= MIN_SHARE * size)
    found = tuple(v[good] for v in spans)
    return tuple(map(np.concatenate, zip(found, _missed(words, h, items, found), strict=True))) if whole else found


def _outermost(hits: np.ndarray) -> np.ndarray:
    """Of rows (row, item, offset, first, last), one for each of the first three, with the least first and the greatest last."""
    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
    head = np.flatnonzero(np.append(True, (hits[1:, :3] != hits[:-1, :3]).any(1))) if len(hits) else np.zeros(0, np.int64)
    if not len(head):
        return hits
    return np.column_stack((hits[head, :3], np.minimum.reduceat(hits[:, 3], head), np.maximum.reduceat(hits[:, 4], head)))


def _masked(words: X.Words, h: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """As _overlaps(), from the first to the last hit of masks on each offset, whether it counts or not."""
    found_at, found_key = [], []
    for mask in range(len(MASKS)):
        key = _keys(h, mask)
        at = np.flatnonzero(items.filter[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = at[at + SPAN <= words.first[words.doc[at] + 1]]
        found_at.append(at)
        found_key.append(key[at])
    at, key = np.concatenate(found_at), np.concatenate(found_key)
    lo, hi = np.searchsorted(items.key, key), np.searchsorted(items.key, key, "right")
    ends = np.cumsum(hi - lo)
    spans, a = [np.zeros((0, 5), np.int64)], 0
    while a < len(at):  # of all hits of BLOCK pairs only the first and last on each offset are kept
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, "right")))
        n = (hi - lo)[a:b]
        to, x = np.repeat(lo[a:b], n) + X.spans(n), np.repeat(at[a:b], n)
        a = b
        item, place = items.item[to], items.place[to]
        spans.append(_outermost(np.column_stack((words.doc[x], item, x - place, place, place))))
        if sum(map(len, spans)) > 2 * BLOCK + 2 * len(spans[0]):
            spans = [_outermost(np.concatenate(spans))]
    row, item, offset, first, end = _outermost(np.concatenate(spans)).T
    if not len(row):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    size = end + SPAN - first
    equal = np.empty(len(size), np.int64)
    step = 20000
    for a in range(0, len(size), step):
        s = size[a : a + step]
        within = X.spans(s)
        x = np.repeat(offset[a : a + step] + first[a : a + step], s) + within
        y = np.repeat(items.first[item[a : a + step]] + first[a : a + step], s) + within
        equal[a : a + step] = np.add.reduceat(h[x] == items.words[y], np.cumsum(s) - s)
    return row, item, offset + first - words.first[row], first, size, equal


def _missed(words: X.Words, h: np.ndarray, items: Items, have: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """As _overlaps(), the stretches that count outside of the overlaps in have, which has one for each offset at most."""
    key, at = _runs(words, h, items.run_filter)
    lo, hi = np.searchsorted(items.run_key, key), np.searchsorted(items.run_key, key, "right")
    ends = np.cumsum(hi - lo)
    found = set()
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, "right")))
        n = (hi - lo)[a:b]
        x, y = np.repeat(at[a:b], n), items.run_at[np.repeat(lo[a:b], n) + X.spans(n)]
        a = b
        row, item = words.doc[x], np.searchsorted(items.first, y, "right") - 1
        before = np.minimum(x - words.first[row], y - items.first[item])
        after = np.minimum(words.first[row + 1] - x, items.first[item + 1] - y)
        # one word before, too: the run is part of a longer one
        own = np.flatnonzero((before == 0) | (h[x - 1] != items.words[y - 1]))
        x, y, row, item, before, after = (v[own] for v in (x, y, row, item, before, after))
        equal = np.zeros(len(x), np.int64)
        for t in range(-BEFORE, AFTER):
            there = np.flatnonzero((-t <= before) & (t < after))
            equal[there] += h[x[there] + t] == items.words[y[there] + t]
        near = np.flatnonzero(equal >= MIN_SHARE * MIN_WORDS)
        place = y[near] - items.first[item[near]]
        found.update(zip(row[near].tolist(), item[near].tolist(), (x[near] - words.first[row[near]] - place).tolist(), strict=True))
    taken = dict(zip(zip(have[0].tolist(), have[1].tolist(), (have[2] - have[3]).tolist(), strict=True), zip(have[3].tolist(), have[4].tolist(), strict=True), strict=True))
    out = []
    for row, item, gap in sorted(found):
        z = min(items.first[item + 1] - items.first[item], words.first[row + 1] - words.first[row] - gap)
        a = max(0, -gap)
        x, y = words.first[row] + gap, items.first[item]
        same = h[x + a : x + z] == items.words[y + a : y + z]
        first, size = taken.get((row, item, gap), (a, 0))
        for lo, hi in ((a, first), (first + size, z)):
            out += [(row, item, gap + lo + s, lo + s, n, equal) for s, n, equal in _stretches(same[lo - a : hi - a])]
    return tuple(np.array(out, np.int64).reshape(-1, 6).T)


def _stretches(same: np.ndarray) -> list[tuple[int, int, int]]:
    """First position, length and equal words of the longest stretch that counts, and of those on either side of it."""
    # by what the words up to a position have of equal ones beyond their share
    beyond = np.append(0, np.cumsum(same - MIN_SHARE))
    out, left = [], [(0, len(same))]
    while left:
        lo, hi = left.pop()
        if hi - lo < MIN_WORDS:
            continue
        part = beyond[lo : hi + 1]
        first = np.searchsorted(-np.minimum.accumulate(part), -part)
        size = np.arange(len(part)) - first
        z = lo + int(np.argmax(size))
        a = z - int(size.max())
        while z - a > MIN_WORDS and not same[a]:
            a += 1
        while z - a > MIN_WORDS and not same[z - 1]:
            z -= 1
        if z - a >= MIN_WORDS:
            out.append((a, z - a, int(same[a:z].sum())))
            left += [(lo, a), (z, hi)]
    return sorted(out)


def _pieces(benchmark: DataFrame) -> Iterator[Items]:
    """The test items, in pieces of about PIECE_BYTES: each is sent to the tasks whole."""
    own = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    own = own.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // PIECE_BYTES + 1
    for i in range(n):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text or ""))
        yield _items(rows)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, item_id, doc_start, item_start (words from 0), n_words and n_equal of each overlap that counts.

    A null text is an empty one; a text of fewer than MIN_WORDS words has no overlap. Null ids are passed on.
    Repeated documents and repeated items each have their own rows; the overlaps of one document with one item at
    different offsets too. A very long text is searched whole; hits with repeated words are reduced to the first and last
    of each offset, a block of them at a time. whole: besides the overlaps that SQL has, those that the masks miss or that fail by what lies
    between two hits; of such an offset the longest stretch that counts is an overlap, and so are those beside it. An empty table on either side gives no rows. Other columns are ignored.
    The documents are read once for each PIECE_BYTES of test texts and are never shuffled.
    """
    own = with_long_id(docs, doc_id, text)
    sc = docs.sparkSession.sparkContext
    out = None
    for items in _pieces(benchmark):
        held = sc.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            item_ids = pa.array(items.ids, pa.int64())
            for batch in batches:
                texts = X.text_array(batch.column(1))
                for lo, hi in X.chunks(texts, CHUNK):
                    row, item, *rest = _overlaps(texts.slice(lo, hi - lo), items, whole)
                    if len(row):
                        row, item, *rest = (np.repeat(x, items.times[item]) for x in (row, item, *rest))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(row + lo)), item_ids.take(pa.array(item)), *(pa.array(x, pa.int32()) for x in rest)],
                            ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"],
                        )

        part = own.mapInArrow(run, "doc_id bigint, item_id bigint, doc_start int, item_start int, n_words int, n_equal int")
        out = part if out is None else out.unionAll(part)
    return out


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """docs, all columns, without the rows that have an overlap with a test item; as overlaps()."""
    names, sc = docs.columns, docs.sparkSession.sparkContext
    out = docs
    for items in _pieces(benchmark):
        held = sc.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = X.text_array(batch.column(names.index(text)))
                keep = np.ones(len(texts), bool)
                for lo, hi in X.chunks(texts, CHUNK):
                    keep[lo + _overlaps(texts.slice(lo, hi - lo), held.value, whole)[0]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), whole=True)


def _seed_sql(table: str, key: str) -> str:
    picked = "CASE mask " + " ".join(
        f"WHEN {m} THEN list_select(w, [{', '.join(f'i + {p + 1}' for p in mask)}])" for m, mask in enumerate(MASKS)
    )
    return f"""SELECT {key}, i, mask, array_to_string({picked} END, ' ') AS seed
  FROM (SELECT *, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM {table} WHERE len(w) >= {SPAN}),
       (SELECT unnest(range({len(MASKS)})) AS mask)"""


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{X.WORD_SQL}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{X.WORD_SQL}') AS w FROM benchmark),
ds AS ({_seed_sql("d", "doc_id")}),
bs AS ({_seed_sql("b", "item_id")}),
spans AS (
  SELECT doc_id, item_id, ds.i - bs.i AS gap, min(bs.i) AS a, max(bs.i) + {SPAN} AS z
  FROM ds JOIN bs USING (mask, seed) GROUP BY ALL
),
counted AS (
  SELECT doc_id, item_id, gap, a, z,
         len(list_filter(range(a, z), lambda t: d.w[t + gap + 1] = b.w[t + 1])) AS n_equal
  FROM spans JOIN d USING (doc_id) JOIN b USING (item_id) WHERE z - a >= {MIN_WORDS}
)
SELECT doc_id, item_id, (a + gap)::INT AS doc_start, a::INT AS item_start, (z - a)::INT AS n_words, n_equal::INT AS n_equal
FROM counted WHERE n_equal >= {MIN_SHARE} * (z - a)
"""
