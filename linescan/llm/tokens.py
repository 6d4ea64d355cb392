"""Token ids as patched frame-of-reference blocks.

A text's ids are cut into blocks of BLOCK. A block stores its minimum, the width that PERCENTILE of the differences
from it fit in, the low bits of all differences at that width, and for the others, the exceptions, place and high
bits. Little-endian, bits from the lowest:

    minimum u32, width u8, ids - 1 u8, exceptions u8, packed bits, exceptions' places u8 each, high bits u32 each

block_starts has the byte at which each block begins, so that any block can be read alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from . import _text as X
from ._spark import read, tokenizer_file, with_long_id

BLOCK = 128
PERCENTILE = 0.9
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pieces of a text that this vocabulary was made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 20
HEAD = 7


@lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: pa.Array, path: str) -> np.ndarray:
    encode = encoding(path).encode_ordinary
    return np.fromiter((len(encode(t)) if t else 0 for t in texts.to_pylist()), np.int64, len(texts))


def pack(ids: np.ndarray, first: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all blocks, where each begins, with the end, and the first block of each text, with the end."""
    if not 1 <= block <= 256:
        raise ValueError("1 <= block <= 256")
    blocks = -(-np.diff(first) // block)
    of = np.concatenate(([0], np.cumsum(blocks)))
    begin = np.repeat(first[:-1], blocks) + X.spans(blocks) * block
    size = np.minimum(block, np.repeat(first[1:], blocks) - begin)
    if not len(begin):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), of
    column = np.arange(block)
    inside = column < size[:, None]
    value = ids[np.minimum(begin[:, None] + column, len(ids) - 1)].astype(np.int64)
    minimum = np.where(inside, value, np.iinfo(np.int64).max).min(1)
    value = np.where(inside, value - minimum[:, None], 0)
    bits = np.frexp(value.astype(np.float64))[1].astype(np.uint8)
    ordered = np.sort(np.where(inside, bits, 255), axis=1)
    width = ordered[np.arange(len(size)), np.ceil(percentile * size).astype(np.int64) - 1].astype(np.int64)
    exception = (bits > width[:, None]) & inside
    count = exception.sum(1)
    packed_size = -(-size * width // 8)
    length = HEAD + packed_size + 5 * count
    start = np.concatenate(([0], np.cumsum(length)))
    out = np.zeros(start[-1], np.uint8)
    at = start[:-1]
    for i in range(4):
        out[at + i] = minimum >> (8 * i) & 255
    out[at + 4], out[at + 5], out[at + 6] = width, size - 1, count
    low = (value & ((1 << width) - 1)[:, None]).astype(np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        spread = (low[rows][:, :, None] >> np.arange(w, dtype=np.uint32) & np.uint32(1)).astype(np.uint8)
        packed = np.packbits(spread.reshape(len(rows), -1), axis=1, bitorder="little")
        use = np.arange(packed.shape[1]) < packed_size[rows][:, None]
        out[((at[rows] + HEAD)[:, None] + np.arange(packed.shape[1]))[use]] = packed[use]
    row, place = np.nonzero(exception)
    nth = X.spans(count)
    out[at[row] + HEAD + packed_size[row] + nth] = place
    high = value[row, place] >> width[row]
    to = at[row] + HEAD + packed_size[row] + count[row] + 4 * nth
    for i in range(4):
        out[to + i] = high >> (8 * i) & 255
    return out, start, of


def unpack_block(data: bytes, start: int = 0) -> np.ndarray:
    """The ids of the block that begins at that byte."""
    head = np.frombuffer(data, np.uint8, HEAD, start)
    width, size, count = int(head[4]), int(head[5]) + 1, int(head[6])
    at = start + HEAD + -(-size * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, at - start - HEAD, start + HEAD), count=size * width, bitorder="little")
    ids = bits.reshape(size, width) @ (1 << np.arange(width, dtype=np.int64))
    place, high = np.frombuffer(data, np.uint8, count, at), np.frombuffer(data, "<u4", count, at + count)
    ids[place] += high.astype(np.int64) << width
    return ids + int(head[:4].copy().view("<u4")[0])


def unpack(data: bytes, block_starts: list[int]) -> np.ndarray:
    """All ids of a text."""
    return np.concatenate([np.zeros(0, np.int64), *(unpack_block(data, s) for s in block_starts)])


def token_blocks(
    docs: DataFrame, vocabulary: str | None = None, block: int = BLOCK, percentile: float = PERCENTILE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, block_starts ARRAY<INT> and data BINARY of every row.

    A null or empty text has no tokens, no blocks and empty data; a null doc_id is passed on; repeated rows are
    each encoded. Special tokens' strings in a text are ordinary text. Other columns are ignored. Texts are never
    cut or shuffled. vocabulary: a file of ranks that every executor can read.
    """
    path = vocabulary or tokenizer_file(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            texts = X.text_array(batch.column(1))
            for lo, hi in X.chunks(texts, CHUNK):
                each = [np.array(encode(t), np.int32) for t in texts.slice(lo, hi - lo).to_pylist()]
                first = np.concatenate(([0], np.cumsum([len(x) for x in each])))
                out, start, of = pack(np.concatenate([np.zeros(0, np.int32), *each]), first, block, percentile)
                bounds = start[of]
                starts = start[:-1] - np.repeat(bounds[:-1], np.diff(of))
                data = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(starts, pa.int32())), data],
                    ["doc_id", "n_tokens", "block_starts", "data"],
                )

    return with_long_id(docs, doc_id, text).mapInArrow(run, "doc_id bigint, n_tokens bigint, block_starts array<int>, data binary")


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks(read(spark, sf_dir, "documents"))
