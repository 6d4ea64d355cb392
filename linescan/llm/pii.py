"""Private data by a linear-chain conditional random field over word shapes.

Words are runs of characters other than white space. A word's features are made from its shape (letters, digits and
signs as runs), its neighbours' shapes and a few cue words. The field is trained on a small labelled table that this
module writes, by gradient ascent on the likelihood (forward-backward), and decoded by Viterbi in batches of
sequences of similar length.

Words without a digit, '@', '=', '+' or quote, and more than REACH words from any that has one, all have the same
features; training checks that the field then says "other" whatever their neighbours are, so that only the stretches
around the others need decoding, with the same result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _text as X
from ._spark import read, with_long_id

LABELS = ("other", "email", "ip", "card", "secret", "phone", "phone_more")
REACH = 3
BITS = 13
SENTENCES = 900  # of the labelled table
SEED = 31
CHUNK = 2 << 20
_SIGNS = np.zeros(256, bool)
_SIGNS[[*range(48, 58), ord("@"), ord("="), ord('"'), ord("+")]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
CUES = ("token", "key", "secret", "password")
#: Signs that may stick to a word at either end and belong to no private datum.
EDGE = ".,;:!?*%&$#|\"'<>[]{}"


@lru_cache(1 << 16)
def _shape(word: str) -> str:
    shape = re.sub(r"\d", "9", word)
    shape = re.sub(r"[^\W\d_]", "a", shape)
    return re.sub(r"(.)\1*", lambda m: m[1] + (str(min(len(m[0]), 20)) if m[1] == "9" else ""), shape)[:40]


@lru_cache(1 << 16)
def _own_features(word: str) -> tuple[str, ...]:
    core = word.strip(EDGE)
    if not any(c.isdigit() or c in '@="+' for c in word):
        return ("plain", "cue:" + core.lower()) if core.lower() in CUES else ("plain",)
    shape = _shape(core)
    digits = sum(c.isdigit() for c in core)
    found = [f"s:{shape}", f"kind:{re.sub('[0-9]+', '9', shape)}", f"digits:{min(digits, 20)}", f"long:{min(len(core) // 4, 12)}"]
    found += [f"has:{c}" for c in "@.-()=+_/:" if c in core]
    if re.fullmatch(r"[0-9a-fA-F]{24,}", core) and re.search("[a-fA-F]", core):
        found.append("hex")
    if core.isdigit():
        found.append(f"only:{min(digits, 20)}")
    parts = core.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts):
        found.append("quad")
    if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s.]{2,}", core):
        found.append("mail")
    if re.fullmatch(r"\d{3}-\d{4}", core):
        found.append("tail")
    if re.fullmatch(r"\(?\d{3}\)", core):
        found.append("area")
    if re.fullmatch(r"\+\d{1,3}", core):
        found.append("plus")
    return tuple(found)


@lru_cache(1 << 17)
def _bins(before: str | None, word: str, after: str | None) -> np.ndarray:
    names = [*_own_features(word), *(f"<{x}" for x in (_own_features(before)[-2:] if before else ("edge",)))]
    names += [f">{x}" for x in (_own_features(after)[-2:] if after else ("edge",))]
    return np.unique([hash_name(x) for x in names])


@lru_cache(1 << 16)
def hash_name(name: str) -> int:
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % (1 << BITS)


def labelled_table(n: int = SENTENCES, seed: int = SEED) -> list[tuple[list[str], list[str]]]:
    """Sentences of made-up words with labels: private data of every kind, and numbers that are none."""
    rng = random.Random(seed)
    syllables = "the an er ing ou tion re at on es en ti th and sch keit ung de la le éau ción ado que für ä".split()

    def plain() -> str:
        word = "".join(rng.choices(syllables, k=rng.randint(1, 4)))
        return rng.choice([word, word, word, word.capitalize(), word.upper(), word + ",", word + ".", word + rng.choice(["!!", "***", "%%%", "$$$", "###", "&&&"])])

    def digits(k: int) -> str:
        return "".join(rng.choices("0123456789", k=k))

    def datum() -> list[tuple[str, str]]:
        kind = rng.choice(["email", "ip", "card", "secret", "phone", "none", "none"])
        if kind == "email":
            sep, name = rng.choice([".", "_", "", "-"]), "".join(rng.choices(syllables, k=2))
            return [(f"{name}{sep}{digits(rng.randint(0, 3))}@mail{digits(rng.randint(0, 1))}.{rng.choice(['example', 'test', 'mail'])}.{rng.choice(['com', 'org', 'net', 'de'])}", "email")]
        if kind == "ip":
            return [(".".join(str(rng.randint(0, 255)) for _ in range(4)), "ip")]
        if kind == "card":
            if rng.random() < 0.2:
                return [("-".join(digits(4) for _ in range(4)), "card")]
            return [(digits(rng.choice([15, 16, 16, 16, 16])), "card")]
        if kind == "secret":
            value = "".join(rng.choices("0123456789abcdef", k=rng.choice([32, 40, 40, 40, 64])))
            quote = rng.choice(['"', '"', "", "'"])
            return [(rng.choice(["token", "key", "secret", "password"]), "other"), (rng.choice(["=", ":"]), "other"), (f"{quote}{value}{quote}", "secret")]
        if kind == "phone":
            form = rng.randint(0, 4)
            if form < 3:
                return [(f"+{rng.randint(1, 99)}", "phone"), (f"({digits(3)})", "phone_more"), (f"{digits(3)}-{digits(4)}", "phone_more")]
            if form == 3:
                return [(f"({digits(3)})", "phone"), (f"{digits(3)}-{digits(4)}", "phone_more")]
            return [(f"{digits(3)}-{digits(3)}-{digits(4)}", "phone")]
        no = rng.choice([digits(rng.randint(1, 9)), f"{rng.randint(0, 9)}.{rng.randint(0, 9)}", f"{rng.randint(0, 99)}%", f"{rng.randint(0, 23)}:{digits(2)}", f"v{rng.randint(1, 9)}",
                         f"{digits(4)}-{digits(2)}-{digits(2)}", f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 99)}", f"${digits(3)}", f"x={digits(1)}", f'"{plain()}"', f"@{plain()}", "=", "+", f"{digits(2)}/{digits(2)}/{digits(4)}"])
        return [(no, "other")]

    table = []
    for _ in range(n):
        row: list[tuple[str, str]] = []
        for _ in range(rng.randint(0, 3)):
            row += [(plain(), "other") for _ in range(rng.randint(0, 5))]
            found = datum()
            if rng.random() < 0.3:
                word, label = found[-1]
                found[-1] = (word + rng.choice([".", ",", "!!", "***", "%%%", "$$$", "###", "&&&"]), label)
            row += found
        row += [(plain(), "other") for _ in range(rng.randint(1, 6))]
        table.append(([w for w, _ in row], [y for _, y in row]))
    return table


def _emissions(weights: np.ndarray, words: list[str]) -> np.ndarray:
    around = [None, *words, None]
    return np.array([weights[_bins(around[i], around[i + 1], around[i + 2])].sum(0) for i in range(len(words))])


@dataclass
class Field:
    weights: np.ndarray  # by feature and label
    moves: np.ndarray  # from label to label
    start: np.ndarray
    certain: bool  # whether words far from signs can't be private


def _sums(scores: np.ndarray, axis: int) -> np.ndarray:
    top = scores.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(scores - top).sum(axis))


@lru_cache(2)
def trained(n: int = SENTENCES, seed: int = SEED, steps: int = 60) -> Field:
    """Ascends the likelihood of the labelled table, by AdaGrad on all its sentences at once."""
    table = labelled_table(n, seed)
    size, longest, kinds = len(table), max(len(w) for w, _ in table), len(LABELS)
    rows, columns, bins = [], [], []
    gold, inside = np.zeros((size, longest), int), np.zeros((size, longest), bool)
    for i, (words, labels) in enumerate(table):
        around = [None, *words, None]
        inside[i, : len(words)] = True
        gold[i, : len(words)] = [LABELS.index(y) for y in labels]
        for t in range(len(words)):
            own = _bins(around[t], around[t + 1], around[t + 2])
            rows += [i] * len(own)
            columns += [t] * len(own)
            bins += own.tolist()
    cell, bins = np.array(rows) * longest + np.array(columns), np.array(bins)
    truth = np.eye(kinds)[gold] * inside[:, :, None]
    weights, moves, start = np.zeros((1 << BITS, kinds)), np.zeros((kinds, kinds)), np.zeros(kinds)
    total = [np.full_like(x, 1e-6) for x in (weights, moves, start)]
    true_moves = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    length = inside.sum(1)
    for step in range(steps):
        e = np.column_stack([np.bincount(cell, weights[bins, k], size * longest) for k in range(kinds)]).reshape(size, longest, kinds)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            new = _sums(forward[:, t - 1, :, None] + moves, 1) + e[:, t]
            forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _sums(moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(inside[:, t + 1, None], new, 0)
        z = _sums(forward[np.arange(size), length - 1], 1)
        chance = np.exp(forward + backward - z[:, None, None]) * inside[:, :, None]
        joint = np.zeros_like(moves)
        for t in range(1, longest):
            pair = forward[:, t - 1, :, None] + moves + (e[:, t] + backward[:, t])[:, None, :] - z[:, None, None]
            joint += (np.exp(np.minimum(pair, 0)) * inside[:, t, None, None]).sum(0)
        miss = (truth - chance).reshape(-1, kinds)
        slope = np.column_stack([np.bincount(bins, miss[cell, k], 1 << BITS) for k in range(kinds)]) - 0.05 * weights
        for x, g, seen in ((weights, slope, total[0]), (moves, true_moves - joint - 0.05 * moves, total[1]), (start, (truth - chance)[:, 0].sum(0) - 0.05 * start, total[2])):
            seen += g * g
            x += 0.5 * g / np.sqrt(seen)
    return Field(weights, moves, start, _certain(weights, moves))


def _certain(weights: np.ndarray, moves: np.ndarray) -> bool:
    """Whether relabelling a run of words without signs as "other" always raises the score of a labelling.

    Such a run may lie between words labelled "other", or reach from a word with signs over two words at least.
    """
    some = [None, "a", *CUES]
    quiet = [weights[_bins(b, w, a)].sum(0) for b in some for w in some[1:] for a in some]
    margin = min(q[0] - q[1:].max() for q in quiet)
    step = moves.max() - moves[0, 0]
    bound = moves.max() - min(moves[:, 0].min(), moves[0].min())
    return bool(margin > 2 * step and 2 * margin > bound + 2 * step and margin > step)


def viterbi(scores: np.ndarray, length: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best labels of sequences[n, t, label] of the given lengths."""
    n, longest, kinds = scores.shape
    back = np.zeros((n, longest, kinds), np.int8)
    best = first + scores[:, 0]
    for t in range(1, longest):
        through = best[:, :, None] + moves
        back[:, t] = through.argmax(1)
        best = np.where((t < length)[:, None], through.max(1) + scores[:, t], best)
    label = np.zeros((n, longest), np.int64)
    at = (best + last).argmax(1)
    for t in range(longest - 1, -1, -1):
        label[:, t] = np.where(t < length, at, 0)
        at = np.where((t < length) & (t > 0), back[np.arange(n), t, at], at)
    return label


def decoded(field: Field, sequences: list[list[str]], edges: np.ndarray | None = None) -> list[list[str]]:
    """Labels of the words of each sequence. edges[i]: whether "other" words come before and after sequence i."""
    out: list[list[str]] = [[]] * len(sequences)
    order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 2000 and len(sequences[order[hi]]) <= 1.3 * len(sequences[order[lo]]) + 4:
            hi += 1
        own = order[lo:hi]
        length = np.array([len(sequences[i]) for i in own])
        scores = np.zeros((len(own), length.max(), len(LABELS)))
        for k, i in enumerate(own):
            scores[k, : length[k]] = _emissions(field.weights, sequences[i])
        first, last = np.tile(field.start, (len(own), 1)), np.zeros((len(own), len(LABELS)))
        if edges is not None:
            first[edges[own, 0]] = field.moves[0]
            last[edges[own, 1]] = field.moves[:, 0]
        found = viterbi(scores, length, field.moves, first, last)
        for k, i in enumerate(own):
            out[i] = [LABELS[y] for y in found[k, : length[k]]]
        lo = hi
    return out


def _chunk(field: Field, texts: pa.Array) -> list[tuple[int, int, int, str]]:
    """Row, first and last byte, and kind of each private datum."""
    data, offsets = X.raw(texts)
    n = len(data)
    if not n:
        return []
    word = ~_BLANK[data]
    head = word.copy()
    head[1:] &= ~word[:-1]
    head[offsets[:-1][offsets[:-1] < n]] |= word[offsets[:-1][offsets[:-1] < n]]
    start = np.flatnonzero(head)
    if not len(start):
        return []
    tail = word.copy()
    tail[:-1] &= ~word[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    tail[ends] |= word[ends]
    end = np.flatnonzero(tail) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    if field.certain:
        marked = np.unique(np.searchsorted(start, np.flatnonzero(_SIGNS[data]), "right") - 1)
        cue = np.zeros(len(start), bool)
        for step in range(-REACH, REACH + 1):
            near = marked + step
            near = near[(near >= 0) & (near < len(start))]
            cue[near] = True
        use = np.flatnonzero(cue)
    else:
        use = np.arange(len(start))
    if not len(use):
        return []
    cut = np.flatnonzero((np.diff(use, prepend=-2) > 1) | (np.diff(row[use], prepend=-1) != 0))
    stop = np.append(cut[1:], len(use))
    text = data.tobytes()
    sequences = [[text[start[w] : end[w]].decode() for w in use[a:b]] for a, b in zip(cut, stop, strict=True)]
    before, after = use[cut] - 1, use[stop - 1] + 1
    edges = np.column_stack([(before >= 0) & (row[before] == row[use[cut]]), (after < len(start)) & (row[np.minimum(after, len(start) - 1)] == row[use[cut]])])
    found = []
    for k, labels in enumerate(decoded(field, sequences, edges)):
        words = use[cut[k] : stop[k]]
        for i, label in enumerate(labels):
            if label == "other":
                continue
            own = sequences[k][i]
            lead, core = len(own) - len(own.lstrip(EDGE)), own.strip(EDGE)
            if not core:
                continue
            a = int(start[words[i]]) + len(own[:lead].encode())
            b = a + len(core.encode())
            if label == "phone_more" and found and found[-1][3] == "phone" and found[-1][0] == row[words[i]] and not text[found[-1][2] : a].strip():
                found[-1] = (found[-1][0], found[-1][1], b, "phone")
            else:
                found.append((int(row[words[i]]), a, b, "phone" if label == "phone_more" else label))
    return found


def private_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id, start and n_chars (characters from 0), kind and value of each private datum.

    kinds: email, ip, card, secret, phone. A null or empty text has none; a null doc_id is passed on; repeated rows
    are each searched. Texts of any length are searched whole. Other columns are ignored.
    """
    model = field or trained()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = X.text_array(batch.column(1))
            for lo, hi in X.chunks(texts, CHUNK):
                part = texts.slice(lo, hi - lo)
                found = _chunk(held.value, part)
                if not found:
                    continue
                data, offsets = X.raw(part)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                row, a, b = (np.array([f[i] for f in found]) for i in range(3))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(row)),
                        pa.array((chars[a] - chars[offsets[row]]).astype(np.int32)),
                        pa.array((chars[b] - chars[a]).astype(np.int32)),
                        pa.array([f[3] for f in found]),
                        pa.array([raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)]),
                    ],
                    ["doc_id", "start", "n_chars", "kind", "value"],
                )

    return with_long_id(docs, doc_id, text).mapInArrow(run, "doc_id bigint, start int, n_chars int, kind string, value string")


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data(read(spark, sf_dir, "documents"))
