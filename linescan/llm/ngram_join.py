"""N-gram Jaccard join by PartEnum signatures.

The features of a document are its distinct runs of n words. Similar documents differ in few features: for a
Jaccard similarity of at least threshold the symmetric difference of two sets with x and y features has at most
(1 - threshold) / (1 + threshold) * (x + y) members. So within a band of sizes the feature domain is cut into
parts by hash, and two similar sets differ in at most k parts. A set signs the first k + 1 of its filled parts, in one
order of all contents of parts: then two similar sets sign one in common. The order begins with what is rare in the
corpus, by a table of counts over all documents, so that what many unlike documents have is hardly ever signed. Every
pair of similar sets lies in one band, that of the smaller one.

Documents of equal text are one from the start. Of those that share a signature each leads in turn, and those whose
sketches of 192 bits are near its own are its candidates, whose similarity is then computed exactly. Pairs of which
sketches say that they are surely similar are united at once, within a bucket of signatures, and what is united isn't
compared any more: a group of near copies isn't spread out to all of its pairs. Where what was united turns out to be several
groups, all documents but those of its largest group are compared again, with all that they share a signature with.

links() leaves what was united as it is, so that a group may be several but no link leaves it, and then compares all
different texts of each group with each other, by their whole sets, in blocks of a group: no sketch is asked there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import FILTER_BYTES, file_bytes, give_back, id_filter, join_narrow, may_hold, read, saved, sparing, with_long_id, without_ids

N = 2
THRESHOLD = 0.65
PARTS = 1.2  # for each feature of the largest set of a band
WHOLE = 5  # up to this band every feature is a part
BLOCK = 1 << 20  # pairs of sketches at once
BUCKET_BYTES = 32 << 20  # of signatures in a bucket, which is a task
SKETCH = 192
FEW = 128  # bits of sketches of which at least one is of a small set
SMALL = 32
SURE = 0.75  # of the expected difference at the threshold
SPREAD = 7  # standard deviations by which a sketch may differ more than expected at the threshold
LOCAL_EDGES = 1 << 20
GROUP_DOCS = 2048  # of a block of a group, about
GROUP_BYTES = 8 << 20  # of their texts
COLUMNS = 1024  # features of a matrix product
COUNT_BITS = 22  # of a hash, that choose one of the counters of the corpus
COUNT_BLOCK = 16
CHUNK = 1 << 19
ROWS = 1024
PACKED_ROWS = 1 << 18  # signatures that are packed at once
EPS = 1e-9


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all texts, sorted by row and hash, and where each row's begin, with the end.

    A text of fewer than n words, but one at least, has all its words as its one feature.
    """
    words = X.split_words(texts)
    h, rows = words.hashes(), len(words.first) - 1
    length = np.diff(words.first)
    gram = X.grams(h, n)
    at = np.flatnonzero(np.arange(len(gram)) + n <= words.first[words.doc[: len(gram)] + 1]) if len(gram) else np.zeros(0, np.int64)
    gram, doc = gram[at], words.doc[at]
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        own = np.repeat(short, length[short])
        place = X.spans(length[short])
        value = h[words.first[own] + place] * X.COEF[place + 64]
        gram = np.concatenate((gram, X.mix(np.add.reduceat(value, np.cumsum(length[short]) - length[short]))))
        doc = np.concatenate((doc, short))
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return gram, np.searchsorted(doc, np.arange(rows + 1))


def _contents(gram: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows and hashes of the filled parts of all sets, for either band that a set can be in; and k and band of each row."""
    size = np.diff(first)
    own = np.where(size > 0, np.frexp(np.maximum(size, 1))[1] - 1, 0)
    low = 1 << own
    for step in (0, 1):
        band = own - step
        if step:  # pairs with a smaller set of the band below
            member = (size > 0) & (own > 0) & (size * threshold <= low - 1 + EPS)
            k = np.floor((1 - threshold) / (1 + threshold) * (size + low - 1) + EPS)
        else:
            member = size > 0
            k = np.floor((1 - threshold) / threshold * size + EPS)
        parts = np.where(band > WHOLE, np.ceil(PARTS * 2.0 ** (band + 1)), 2.0**60).astype(np.uint64)
        rows = np.flatnonzero(member)
        if not len(rows):
            continue
        of = np.repeat(rows, size[rows])
        g = gram[np.repeat(first[rows], size[rows]) + X.spans(size[rows])]
        part = X.mix(g ^ X.COEF[200]) % parts[of]
        order = np.lexsort((part, of))  # features stay sorted by hash within a part
        of, part, g = of[order], part[order], X.mix(g[order] + X.COEF[201])
        cut = np.ones(len(of), bool)
        cut[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1])
        head = np.flatnonzero(cut)
        row = of[head]
        yield row, X.mix(np.add.reduceat(g, head) + X.mix(part[head] * X.COEF[202] + band[row].astype(np.uint64))), k, band


def _counter(sign: np.ndarray) -> np.ndarray:
    return (sign >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _signatures(gram: np.ndarray, first: np.ndarray, threshold: float, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their signatures; level: how frequent the contents of each counter are."""
    rows = len(first) - 1
    out_row, out_sign = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for row, sign, k, band in _contents(gram, first, threshold):
        order = np.lexsort((sign, level[_counter(sign)], row))
        row, sign = row[order], sign[order]
        filled = np.bincount(row, minlength=rows)
        use = X.spans(filled[filled > 0]) <= k[row]
        out_row.append(row[use])
        out_sign.append(sign[use])
        lacking = np.flatnonzero((filled > 0) & (filled <= k))  # too few parts: any two such sets meet here
        out_row.append(lacking)
        out_sign.append(X.mix(X.COEF[203] + band[lacking].astype(np.uint64)))
    return np.concatenate(out_row), np.concatenate(out_sign)


def _without(batch: pa.RecordBatch, drop) -> pa.RecordBatch:
    """The rows whose id isn't in a sorted, broadcast array."""
    if drop is None or not len(drop.value):
        return batch
    ids = batch.column(0).to_numpy()
    place = np.minimum(np.searchsorted(drop.value, ids), len(drop.value) - 1)
    return batch.filter(pa.array(drop.value[place] != ids))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of a batch(doc_id, text), about CHUNK bytes at once; only a few texts are converted at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        texts = X.text_array(part.column(1))
        for lo, hi in X.chunks(texts, CHUNK):
            yield part.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo)
    give_back()


def _counted(n: int, threshold: float, drop):
    """How often the contents of each counter are in the documents of a task, in blocks of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for _, texts in _parts(_without(batch, drop)):
                for _, sign, _, _ in _contents(*_sets(texts, n), threshold):
                    np.add.at(total, _counter(sign), np.uint32(1))
        zip_ = zstandard.ZstdCompressor(level=1)
        for block, part in enumerate(total.reshape(-1, 1 << COUNT_BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zip_.compress(part.tobytes())], pa.binary())], ["block", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of bits of each counter's sum over all tasks, block by block; the batches come sorted by block."""

    def ready() -> pa.RecordBatch:
        level = np.frexp(total.astype(np.float64))[1].astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "level"])

    unzip, block, total = zstandard.ZstdDecompressor(), None, None
    for batch in batches:
        for b, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != block:
                if block is not None:
                    yield ready()
                block, total = b, np.zeros(1 << COUNT_BLOCK, np.uint64)
            total += np.frombuffer(unzip.decompress(counts.as_py()), np.uint32)
    if block is not None:
        yield ready()


def levels(docs: DataFrame, n: int, threshold: float, drop=None) -> np.ndarray:
    """For each of 2**COUNT_BITS counters the bits of the number of sets that have its contents: of a fixed size, 4 MB."""
    counts = docs.mapInArrow(_counted(n, threshold, drop), "block int, counts binary")
    parts = min(1 << (COUNT_BITS - COUNT_BLOCK), docs.sparkSession.sparkContext.defaultParallelism)
    rows = counts.repartitionById(parts, F.col("block") % parts).sortWithinPartitions("block").mapInArrow(_summed, "block int, level binary")
    out = np.zeros((1 << (COUNT_BITS - COUNT_BLOCK), 1 << COUNT_BLOCK), np.uint8)
    found = rows.toArrow()  # at once: shuffle files may be gone after the job
    for block, level in zip(found["block"].to_pylist(), found["level"], strict=True):
        out[block] = np.frombuffer(level.as_py(), np.uint8)
    return out.reshape(-1)


def _sketches(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three words for each set: a bit of the smallest feature in each of SKETCH ranges of hashes.

    Such bits differ for half of the ranges in which sets differ. Of sets of fewer than SMALL features, the last
    word is a hash of the whole set instead.
    """
    size = np.diff(first)
    rows = len(size)
    row = np.repeat(np.arange(rows), size)
    place = row * SKETCH + ((gram >> np.uint64(32)) * np.uint64(SKETCH) >> np.uint64(32)).astype(np.int64)
    head = np.flatnonzero(np.diff(place, prepend=-1))
    bits = np.zeros(rows * SKETCH, np.uint8)
    bits[place[head]] = (X.mix(gram[head] + X.COEF[204]) >> np.uint64(63)).astype(np.uint8)
    out = np.packbits(bits.reshape(rows, SKETCH), axis=1).view(np.uint64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(X.mix(gram + X.COEF[206]))))
    small = size < SMALL
    out[small, -1] = (total[first[1:]] - total[first[:-1]])[small]
    return out


def _compared(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, exact: bool, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Whether sketches of sets of x and y features may be of similar sets, and whether they almost surely are.

    Each feature in which sets differ changes one bit at most, and half of the bits whose smallest feature differs.
    exact: by the first of these alone, which rules out no similar sets whatever.
    """
    d = np.bitwise_count(a ^ b).astype(np.int64)
    small = (x < SMALL).astype(int) + (y < SMALL)
    apart = (1 - threshold) / (1 + threshold) * (x + y)
    bits = np.where(small == 0, SKETCH, FEW)
    expected = np.minimum(bits * (1 - threshold) / 2, apart * bits / SKETCH / 2)
    found = np.where(small == 0, d.sum(1), d[:, :2].sum(1))
    most = apart if exact else np.minimum(expected + SPREAD * np.sqrt(expected * (1 + threshold) / 2), apart)
    near = found <= most + EPS
    return near, near & np.where(small == 0, found <= sure * expected, (small == 2) & (d[:, -1] == 0))


def _signed(n: int, threshold: float, parts: int, held, drop=None, only=None):
    """Packed rows of signatures by bucket: 6 bytes of each, after 37 for each of the documents that have some there.

    held: the broadcast levels; drop: broadcast ids of the documents that aren't wanted; only: a broadcast Bloom filter
    of the signatures that are.
    """

    def packed(ids: np.ndarray, size: np.ndarray, sketch: np.ndarray, row: np.ndarray, sign: np.ndarray) -> pa.RecordBatch:
        sign = X.mix(sign)
        bucket = (sign % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((row, bucket))
        row, sign, bucket = row[order], sign[order], bucket[order]
        head = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        length = np.diff(np.append(head, len(row)))
        pieces = -(-length // 255)  # a document with more in a bucket is there several times
        count = np.full(pieces.sum(), 255)
        count[np.cumsum(pieces) - 1] = length - 255 * (pieces - 1)
        doc, of = np.repeat(row[head], pieces), np.repeat(bucket[head], pieces)
        edge = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        to = np.concatenate(([0], np.cumsum(count)))[edge]
        columns = [ids[doc], size[doc].astype(np.int32), count.astype(np.uint8), sketch[doc]]
        out = [[c[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)] for c in columns]
        for part in ((sign & np.uint64(0xFFFFFFFF)).astype(np.uint32), (sign >> np.uint64(32)).astype(np.uint16)):
            out.append([part[a:b].tobytes() for a, b in zip(to[:-1], to[1:], strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(of[edge[:-1]], pa.int32()), *(pa.array(c, pa.binary()) for c in out)], ["bucket", *_PACKED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, ...]] = []  # of several parts, so that there are fewer and longer packed rows
        rows = signs = 0
        for batch in batches:
            for ids, texts in _parts(_without(batch, drop)):
                gram, first = _sets(texts, n)
                row, sign = _signatures(gram, first, threshold, held.value)
                if only is not None:
                    want = may_hold(only.value, sign.view(np.int64))
                    row, sign = row[want], sign[want]
                if not len(row):
                    continue
                done.append((ids.to_numpy(), np.diff(first), _sketches(gram, first), row + rows, sign))
                rows, signs = rows + len(ids), signs + len(row)
                if signs >= PACKED_ROWS:
                    yield packed(*map(np.concatenate, zip(*done, strict=True)))
                    done.clear()
                    rows = signs = 0
        if done:
            yield packed(*map(np.concatenate, zip(*done, strict=True)))

    return run


_PACKED = ("docs", "sizes", "counts", "sketches", "low", "high")


def _found(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The representatives of x; p points towards them, and is shortened on the way."""
    while True:
        up = p[x]
        upper = p[up]
        if np.array_equal(up, upper):
            return up
        p[x] = upper


def _unite(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        x, y = _found(p, a), _found(p, b)
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))


def _sharing(held: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Ids, sizes and sketches of a bucket's documents; and document and group of each signature that isn't alone, by group."""
    kinds = (np.int64, np.int32, np.uint8, np.uint64, np.uint32, np.uint16)
    doc, size, count, sketch, low, high = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate(kinds))
    held.clear()
    sign = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    del low, high
    ordered = np.sort(sign)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    at, group = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(sign) if len(shared) else 0, 1 << 18):  # most signatures are nobody else's
        part = sign[lo : lo + (1 << 18)]
        place = np.minimum(np.searchsorted(shared, part), len(shared) - 1)
        hit = np.flatnonzero(shared[place] == part)
        at.append(lo + hit)
        group.append(place[hit])
    del sign
    row = np.searchsorted(np.cumsum(count, dtype=np.int64), np.concatenate(at), "right")
    used, row = np.unique(row, return_inverse=True)
    doc, size, sketch = doc[used], size[used], sketch.reshape(-1, SKETCH // 64)[used]
    id_, of = np.unique(doc, return_inverse=True)  # rows that share an id are one document
    group = np.concatenate(group)
    order = np.lexsort((of[row], group))
    return doc, of, size, sketch, row[order], group[order]


def _bucket_pairs(held: list[list[bytes]], threshold: float, exact: bool, certain: float = SURE, loose: bool = False) -> tuple[np.ndarray, ...]:
    """Pairs of ids to compare, and for those that are taken to be similar the group that they belong to, else -1.

    loose: without the pairs of which others make one group anyway.
    """
    doc, of, size, sketch, row, group = _sharing(held)
    p = np.arange(int(of.max()) + 1 if len(of) else 0)
    found, links = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    waiting = 0
    while len(row):
        head = np.flatnonzero(np.diff(group, prepend=-1))
        length = np.diff(np.append(head, len(row)))
        lead = row[np.repeat(head, length)]
        label = _found(p, of[row])
        near = (label != np.repeat(label[head], length)) & (np.minimum(size[lead], size[row]) >= threshold * np.maximum(size[lead], size[row]) - EPS)
        at = np.flatnonzero(near)
        a, b = lead[at], row[at]
        may, sure = np.zeros((2, len(a)), bool)
        for lo in range(0, len(a), BLOCK // 8):
            x, y = a[lo : lo + BLOCK // 8], b[lo : lo + BLOCK // 8]
            may[lo : lo + len(x)], sure[lo : lo + len(x)] = _compared(sketch[x], sketch[y], size[x], size[y], threshold, exact, certain)
        found.append(np.column_stack((of[a[may & ~sure]], of[b[may & ~sure]])))
        if sure.any():
            new = np.unique(np.column_stack((of[a[sure]], of[b[sure]])), axis=0)
            _unite(p, new[:, 0], new[:, 1])
            links.append(new)
            label = _found(p, of[row])
        left = np.ones(len(row), bool)
        left[head] = False
        row, group, label = row[left], group[left], label[left]
        if len(row):  # what is all united needs no more leaders
            head = np.flatnonzero(np.diff(group, prepend=-1))
            length = np.diff(np.append(head, len(row)))
            several = np.repeat(np.minimum.reduceat(label, head) < np.maximum.reduceat(label, head), length)
            row, group = row[several], group[several]
        waiting += len(found[-1])
        if waiting > BLOCK:
            found, waiting = [np.unique(np.concatenate(found), axis=0)], 0
    pairs, links = np.unique(np.concatenate(found), axis=0), np.unique(np.concatenate(links), axis=0)
    if loose:
        pairs = pairs[_found(p, pairs[:, 0]) != _found(p, pairs[:, 1])]
    ids = np.unique(doc)
    label = ids[_found(p, links[:, 0])] if len(links) else np.zeros(0, np.int64)
    both = np.concatenate((pairs, links))
    return ids[both[:, 0]], ids[both[:, 1]], np.concatenate((np.full(len(pairs), np.iinfo(np.int64).min), label))


def _pairs_with(held: list[list[bytes]], threshold: float, exact: bool, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """As _bucket_pairs(), all candidates of the documents that a Bloom filter has, none united with others."""
    doc, of, size, sketch, row, group = _sharing(held)
    head = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    wanted = np.flatnonzero(may_hold(words, doc)[row]) if len(row) else row
    begin, length = head[:-1][np.searchsorted(head, wanted, "right") - 1], np.diff(head)[np.searchsorted(head, wanted, "right") - 1]
    ends = np.cumsum(length)
    found, lo = [np.zeros((0, 2), np.int64)], 0
    while lo < len(wanted):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
        n = length[lo:hi]
        a, b = row[np.repeat(wanted[lo:hi], n)], row[np.repeat(begin[lo:hi], n) + X.spans(n)]
        near = np.flatnonzero((of[a] != of[b]) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - EPS))
        a, b = a[near], b[near]
        may, _ = _compared(sketch[a], sketch[b], size[a], size[b], threshold, exact)
        pairs = np.sort(np.column_stack((doc[a[may]], doc[b[may]])), axis=1)
        found = [np.unique(np.concatenate((*found, pairs)), axis=0)]
        lo = hi
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1], np.full(len(pairs), np.iinfo(np.int64).min)


def _candidates(threshold: float, exact: bool, sure: float, only=None, loose: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready() -> pa.RecordBatch:
            a, b, label = _bucket_pairs(held, threshold, exact, sure, loose) if only is None else _pairs_with(held, threshold, exact, only.value)
            none = label == np.iinfo(np.int64).min
            give_back()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), bucket), pa.int32()), pa.array(label, mask=none)], ["a", "b", "bucket", "united"])

        bucket, held = None, []
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and held:
                    yield ready()
                    held = []
                bucket = b
                held.append(row)
        if held:
            yield ready()

    return run


def _grams(n: int, held):
    """32 bits of each feature, and of how many they equal those of another one of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held is not None:
                batch = batch.filter(pa.array(may_hold(held.value, batch.column(0).to_numpy())))
            for ids, texts in _parts(batch):
                gram, first = _sets(texts, n)
                high = (gram >> np.uint64(32)).astype(np.uint32)
                same = np.concatenate(([0], np.cumsum(high[1:] == high[:-1]), [0])) if len(high) else np.zeros(2, np.int64)
                last = np.maximum(first[1:] - 1, first[:-1])
                grams = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(high.view(np.int32)))
                found = pa.RecordBatch.from_arrays([ids, grams, pa.array((same[last] - same[first[:-1]]).astype(np.int32))], ["doc_id", "grams", "alike"])
                yield found.filter(pa.array(np.diff(first) > 0))

    return run


def candidate_pairs(docs: DataFrame, n: int, threshold: float, exact: bool, sure: float, held, parts: int, drop=None, only=None, signs=None, loose: bool = False) -> DataFrame:
    """Pairs (a, b) of ids with a shared signature, bucket, and united, the group in the bucket of those taken to be similar."""
    return (
        docs.mapInArrow(_signed(n, threshold, parts, held, drop, signs), "bucket int, " + ", ".join(f"{x} binary" for x in _PACKED))
        .repartitionById(parts, "bucket")
        .mapInArrow(_candidates(threshold, exact, sure, only, loose), "a bigint, b bigint, bucket int, united bigint")
    )


def _verified(docs: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Those of distinct, saved pairs whose similarity reaches the threshold, and very few that 32 bits don't tell from them."""
    ids = saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    words = id_filter(ids)
    held = None if words is None else docs.sparkSession.sparkContext.broadcast(words)
    sets = docs.mapInArrow(_grams(n, held), "doc_id bigint, grams array<int>, alike int")
    if held is None:
        sets = join_narrow(sets, ids, "doc_id", "inner", 16)
    sets = saved(sets, "sets")
    a = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x"), F.col("alike").alias("p"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"), F.col("alike").alias("q"))
    both = pairs.join(b, "b").join(a.hint("shuffle_hash"), "a")
    common = F.size(F.array_intersect("x", "y")) + F.least("p", "q")  # which has what is alike once only
    return (
        both.withColumn("common", common)
        .where(F.col("common") >= threshold * (F.size("x") + F.size("y") - F.col("common")) - EPS)
        .select("a", "b")
        .distinct()
    )


def _signs(n: int, threshold: float, held, only):
    """The signatures of the documents that a Bloom filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(only.value, batch.column(0).to_numpy())))
            for _, texts in _parts(batch):
                _, sign = _signatures(*_sets(texts, n), threshold, held.value)
                yield pa.RecordBatch.from_arrays([pa.array(sign.view(np.int64))], ["sign"])

    return run


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, exact: bool = False, sure: float = SURE, without: DataFrame | None = None, loose: bool = False) -> DataFrame:
    """(node, root) of each document that is linked with one of a smaller id, root the smallest, by similar pairs.

    loose: by those too that are only taken to be similar, so that a group may be several, but no link leaves it.

    docs: doc_id, text, without null ids; without: a saved table of ids that are left out, which is sent to the tasks
    where it isn't more than FILTER_BYTES.
    """
    sc, size, drop = docs.sparkSession.sparkContext, file_bytes(docs), None
    if without is not None:
        if without.count() * 8 <= FILTER_BYTES:
            drop = sc.broadcast(np.sort(without.toArrow().column(0).to_numpy()))
        else:
            docs = without_ids(docs, without)
    held = sc.broadcast(levels(docs, n, threshold, drop))
    # signatures have 6 bytes for 0.8 of the words, and 37 for each bucket of a document; the files about 3 bytes a word
    parts = max(int(size * 2 / BUCKET_BYTES) + 1, sc.defaultParallelism * 2)
    rows = saved(candidate_pairs(docs, n, threshold, exact, sure, held, parts, drop, loose=loose), "candidates")
    if loose:
        asked = saved(rows.where("united IS NULL").select("a", "b").distinct(), "pairs")
        return closed(_verified(docs, asked, n, threshold).union(rows.where("united IS NOT NULL").select("a", "b")))
    found = saved(_verified(docs, saved(rows.select("a", "b").distinct(), "pairs"), n, threshold), "similar")
    roots = saved(closed(found), "roots")
    again = saved(_parted(rows.where("united IS NOT NULL"), roots), "again")
    if again.isEmpty():
        return roots
    words = id_filter(again)
    only = sc.broadcast(np.full(1, -1, np.int64).view(np.uint64) if words is None else words)  # too many: all
    wanted = None if words is None else id_filter(saved(docs.mapInArrow(_signs(n, threshold, held, only), "sign bigint").distinct(), "signs"))
    signs = None if wanted is None else sc.broadcast(wanted)
    more = candidate_pairs(docs, n, threshold, exact, sure, held, parts, drop, only, signs).select("a", "b").distinct().join(found, ["a", "b"], "left_anti")
    return closed(roots.toDF("a", "b").union(_verified(docs, saved(more, "pairs"), n, threshold)))


def _parted(united: DataFrame, roots: DataFrame) -> DataFrame:
    """The documents that were united in a bucket with others they aren't linked to, without those of the largest group there."""
    ends = united.select("bucket", "united", F.col("a").alias("node")).union(united.select("bucket", "united", "b")).distinct()
    placed = ends.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = placed.groupBy("bucket", "united", "root").agg(F.count("*").alias("n"))
    largest = groups.groupBy("bucket", "united").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("groups")).where("groups > 1")
    return placed.join(largest, ["bucket", "united"]).where("root <> largest").select(F.col("node").alias("doc_id")).distinct()


def closed(pairs: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, root): the connected components of pairs (a, b), by alternating large and small stars.

    Least neighbours are aggregated before they are shuffled and joined, so that a node with very many is no single task.
    At most local edges, 16 MB of them, are closed on the driver instead, which saves some ten jobs.
    """
    edges = saved(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.count() <= local:
        found = edges.toArrow()
        u, v = found["u"].to_numpy(), found["v"].to_numpy()
        ids = np.unique(np.concatenate((u, v)))
        p = np.arange(len(ids))
        _unite(p, np.searchsorted(ids, u), np.searchsorted(ids, v))
        root = _found(p, np.arange(len(ids)))
        later = np.flatnonzero(root != np.arange(len(ids)))
        return pairs.sparkSession.createDataFrame(pa.table({"node": ids[later], "root": ids[root[later]]}), "node bigint, root bigint")
    seen = None
    while True:
        sides = edges.union(edges.select("v", "u"))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").union(low.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        edges = saved(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def equal_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, rep) of each document with the text of another one of smaller id, rep the smallest; saved.

    Texts are told apart by two hashes of together 192 bits, and those without a word are equal to nothing. An id of
    several rows neither goes nor stands for others, since it may have several texts. Ids are aggregated before they are
    shuffled.
    """
    several = saved(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    keyed = docs if several.isEmpty() else without_ids(docs, several)
    keyed = keyed.where(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")).select("doc_id", F.unhex(F.md5("text")).alias("h"), F.xxhash64("text").alias("g"))
    firsts = keyed.groupBy("h", "g").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    return saved(join_narrow(keyed, saved(firsts, "firsts"), ["h", "g"], "inner", 48).where("doc_id > rep").select("doc_id", "rep"), "equal")


def _common(gram: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many features each of the sets left has in common with each other one of the sets right; not with itself.

    What few sets have is counted pair by pair, the rest by matrix products.
    """
    rows = len(first) - 1
    column, count = np.unique(gram, return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(rows), np.diff(first))
    want = count[column] > 1
    column, row = column[want], row[want]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    rare = count[column] * 14 < rows
    at = np.full((2, rows), -1)
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)))
    flat = out.reshape(-1)
    x, y = rare & (at[0, row] >= 0), rare & (at[1, row] >= 0)
    x_row, x_column, y_row, y_column = at[0, row[x]], column[x], at[1, row[y]], column[y]
    begin = np.searchsorted(y_column, x_column)
    length = np.searchsorted(y_column, x_column, "right") - begin
    ends, lo = np.cumsum(length), 0
    while lo < len(x_row):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
        n = length[lo:hi]
        np.add.at(flat, np.repeat(x_row[lo:hi], n) * len(right) + y_row[np.repeat(begin[lo:hi], n) + X.spans(n)], 1.0)
        lo = hi
    column, row = column[~rare], row[~rare]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        has = np.zeros((rows, int(column[b - 1]) + 1 - lo), np.float32)
        has[row[a:b], column[a:b] - lo] = 1
        out += has[left] @ has[right].T
    return out


def _block_links(ids: np.ndarray, copies: np.ndarray, right: np.ndarray, gram: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Ids, the smallest that each is linked to here, and the number of its links; of one block, or between that and right."""
    order = np.argsort(ids, kind="stable")
    two = bool(right.any()) and not right.all()
    a = order[~right[order]] if two else order
    b = order[right[order]] if two else order
    size, common = np.diff(first), _common(gram, first, a, b)
    similar = common >= threshold * (size[a][:, None] + size[b] - common) - EPS
    del common
    head_a, head_b = (np.flatnonzero(np.diff(ids[x], prepend=ids[x[0]] - 1)) for x in (a, b))
    if len(head_a) < len(a):
        similar = np.logical_or.reduceat(similar, head_a, axis=0)
    if len(head_b) < len(b):
        similar = np.logical_or.reduceat(similar, head_b, axis=1)
    a, b = a[head_a], b[head_b]
    if not two:
        np.fill_diagonal(similar, False)
    x, y = np.nonzero(similar)
    own = ids[np.concatenate((a, b))] if two else ids[a]
    n = np.bincount(x, copies[b][y], len(a))
    if two:
        y = y + len(a)
        n = np.concatenate((n, np.bincount(y - len(a), copies[a][x], len(b))))
    rank = np.argsort(own)
    place = np.empty(len(own), np.int64)
    place[rank] = np.arange(len(own))
    p = np.arange(len(own))
    _unite(p, place[x], place[y])
    return own, own[rank][_found(p, place)], n.astype(np.int64)


def _blocks(n: int):
    """The set of each text of batches(doc_id, text, root, copies, blocks), for all the pairs of blocks of its group that it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for ids, texts in _parts(batch.select(["doc_id", "text"])):
                root, copies, blocks = (batch.column(c).slice(lo, len(ids)).to_numpy() for c in ("root", "copies", "blocks"))
                lo += len(ids)
                gram, first = _sets(texts, n)
                row = np.flatnonzero(np.diff(first) > 0)
                row, k = np.repeat(row, blocks[row]), X.spans(blocks[row])
                id_ = ids.to_numpy()[row]
                own = (X.mix(id_.view(np.uint64) + X.COEF[207]) % blocks[row].astype(np.uint64)).astype(np.int64)
                for at in range(0, len(row), ROWS):
                    r, o, other = row[at : at + ROWS], own[at : at + ROWS], k[at : at + ROWS]
                    sets = pa.array([gram[first[x] : first[x + 1]].tobytes() for x in r.tolist()], pa.binary())
                    columns = [root[r], np.minimum(o, other).astype(np.int32), np.maximum(o, other).astype(np.int32), id_[at : at + ROWS], copies[r]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(o > other), sets], ["root", "i", "j", "doc_id", "copies", "later", "grams"])

    return run


def _compared_blocks(threshold: float):
    """The links within batches(root, i, j, doc_id, copies, later, grams), sorted by root, i, j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, ...]] = []

        def close() -> None:
            if len(held) > 1 and (key[1] == key[2] or len({x[2] for x in held}) > 1):
                gram = np.frombuffer(b"".join(x[3] for x in held), np.uint64)
                first = np.cumsum([0, *(len(x[3]) // 8 for x in held)])
                ids, copies, later = (np.array([x[i] for x in held], t) for i, t in enumerate((np.int64, np.int64, bool)))
                done.append(_block_links(ids, copies, later, gram, first, threshold))
            held.clear()

        def ready() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*done, strict=True)]
            done.clear()
            give_back()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n"])

        key, held = None, []
        for batch in batches:
            for *at, id_, copies, later, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    close()
                    key = at
                held.append((id_, copies, later, grams))
            if done:
                yield ready()
        close()
        if done:
            yield ready()

    return run


def _holding(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held.value, batch.column(0).to_numpy())))

    return run


def _linked_within(docs: DataFrame, roots: DataFrame, copies: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, n), saved: documents, another one that each is linked with by what was compared, or itself, and its links there.

    roots(node, root): groups within which all links are; copies(doc_id, copies): for how many a document stands.
    """
    members = roots.select(F.col("node").alias("doc_id"), "root").union(roots.select("root", "root").distinct())
    members = saved(members.join(copies, "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint"))), "members")
    words = id_filter(members.select("doc_id"))
    if words is not None:
        docs = docs.mapInArrow(_holding(docs.sparkSession.sparkContext.broadcast(words)), "doc_id bigint, text string")
    # a group of many or long texts is compared in pairs of blocks
    sizes = join_narrow(docs.select("doc_id", F.octet_length("text").alias("bytes")), members, "doc_id", "inner")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / GROUP_DOCS), F.ceil(F.sum("bytes") / GROUP_BYTES)).cast("int")
    sizes = saved(sizes.groupBy("root").agg(blocks.alias("blocks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")), "blocks")
    sent = sizes.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0
    parts = max(int(sent * 2 / BUCKET_BYTES) + 1, docs.sparkSession.sparkContext.defaultParallelism)
    cut = saved(members.join(sizes.select("root", "blocks"), "root"), "cut").select("doc_id", "root", "copies", "blocks")
    sets = join_narrow(docs, cut, "doc_id", "inner").select("doc_id", "text", "root", "copies", "blocks")
    sets = sets.mapInArrow(_blocks(n), "root bigint, i int, j int, doc_id bigint, copies bigint, later boolean, grams binary")
    at = ["root", "i", "j"]
    return saved(sets.repartition(parts, *at).sortWithinPartitions(*at).mapInArrow(_compared_blocks(threshold), "a bigint, b bigint, n bigint"), "links")


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """(doc_id, group_id, n_links), a row for each document: its group, and with how many others its similarity reaches threshold.

    Copies count too, each as one. group_id is the smallest doc_id that is linked with it, over others or not, or its own.
    Groups are found by near_copies()' ways; within them all different texts are compared by their whole sets. Cases: see
    near_copies().
    """
    own = with_long_id(docs, doc_id, text).where("doc_id IS NOT NULL")
    with sparing(docs.sparkSession, ROWS):
        equal = equal_texts(own)
        copies = saved(equal.groupBy(F.col("rep").alias("doc_id")).agg((F.count("*") + 1).alias("copies")), "copies")
        roots = saved(linked(own, n, threshold, exact, without=equal.select("doc_id"), loose=True), "roots")
        found = _linked_within(own, roots, copies, n, threshold)
        each = found.groupBy(F.col("a").alias("doc_id")).agg(F.sum("n").alias("n")).join(closed(found).toDF("doc_id", "root"), "doc_id", "left")
        each = each.join(copies, "doc_id", "full").select(
            F.col("doc_id").alias("rep"), "root", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")
        )
        each = saved(each, "each")
    placed = own.select("doc_id").distinct().join(equal, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    return placed.join(each, "rep", "left").select(
        "doc_id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )


def near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """(doc_id, group_id) of each document that is in a group but isn't its first.

    A group is a set of documents linked by pairs whose n-gram Jaccard similarity is at least threshold; group_id is
    its smallest doc_id. Texts of no word, and null texts, are like nothing; texts of fewer than n words are like
    texts of the same words. Rows with a null doc_id are left out. Rows that share a doc_id are one document, linked
    if any of them is. Other columns are ignored. An empty table has no groups. A very long text is one set, which a
    task has to hold, with about 80 bytes for each of its words.

    A pair is ruled out by sketches only if they differ by SPREAD standard deviations more than those of a pair
    just at the threshold: by the binomial distribution less than 1 of 10**9 such pairs, and none of sets of together
    fewer than some 330 features, of which the sketch can't differ so much. exact: only by what no similar pair can have, so that very many more
    pairs are compared.
    """
    own = with_long_id(docs, doc_id, text).where("doc_id IS NOT NULL")
    with sparing(docs.sparkSession, ROWS):
        equal = equal_texts(own)
        roots = saved(linked(own, n, threshold, exact, without=equal.select("doc_id")).toDF("rep", "root"), "roots")
    copies = join_narrow(equal, roots, "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("group_id"))
    return roots.toDF("doc_id", "group_id").union(copies)


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """A row for each group: group_id, doc_ids (sorted, the first is group_id), n_docs. Cases: see near_copies()."""
    found = links(docs, n, threshold, doc_id, text, exact).where("n_links > 0")
    return found.groupBy("group_id").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"), F.count("*").alias("n_docs"))


def without_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with only the first document of each group; documents in no group stay."""
    drop = saved(near_copies(docs, n, threshold).select("doc_id"), "copies")
    return without_ids(docs, drop)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(read(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '{X.WORD_SQL}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {N}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {N - 1}, 1))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY ALL),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
edges AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE c >= {THRESHOLD} * (s.n + t.n - c) - {EPS}
),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS doc_id, min(b) AS group_id FROM (SELECT * FROM reach UNION SELECT a, a FROM edges) GROUP BY a)
SELECT doc_id, coalesce(group_id, doc_id) AS group_id, coalesce(n, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
LEFT JOIN roots USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM edges GROUP BY a) USING (doc_id)
"""
