import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linescan.llm import tokens as T
from linescan.llm._spark import tokenizer_file
from tests.llm.cases import AWKWARD, frame


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40), max_size=300), max_size=5), st.sampled_from([1, 7, 128, 256]), st.sampled_from([0.01, 0.5, 0.9, 1.0]))
def test_round_trip(texts, block, percentile):
    first = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(int)
    out, start, of = T.pack(np.array([i for x in texts for i in x], np.int64), first, block, percentile)
    data = out.tobytes()
    for k, text in enumerate(texts):
        own = start[of[k] : of[k + 1]]
        assert len(own) == -(-len(text) // block)
        assert T.unpack(data, own.tolist()).tolist() == text
        for j, at in enumerate(own.tolist()):
            assert T.unpack_block(data, at).tolist() == text[j * block : (j + 1) * block]


def test_width_fits_the_percentile():
    ids = np.array([5] * 115 + [5 + 2**16] * 13)
    out, _, _ = T.pack(ids, np.array([0, 128]), 128, 0.89)
    assert out[4] == 0 and out[6] == 13 and len(out) == T.HEAD + 5 * 13
    assert T.pack(ids, np.array([0, 128]), 128, 0.95)[0][4] == 17


def test_wrong_block():
    with pytest.raises(ValueError):
        T.pack(np.array([1]), np.array([0, 1]), 257)


def test_documents(spark):
    encode = T.encoding(tokenizer_file(T.VOCABULARY)).encode_ordinary
    rows = [*AWKWARD, (20, "<|endoftext|> special"), (21, "it's 3 o'clock\n\n  now")]
    got = sorted(((r.doc_id, r.n_tokens, T.unpack(bytes(r.data), r.block_starts).tolist()) for r in T.token_blocks(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(((i, len(x), x) for i, t in rows for x in [encode(t or "")]), key=repr)
    assert T.token_blocks(frame(spark, [])).count() == 0


def test_whole_table(spark, small):
    encode = T.encoding(tokenizer_file(T.VOCABULARY)).encode_ordinary
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = T.op9_token_blocks(spark, small).collect()
    assert len(rows) == len(text)
    assert all(T.unpack(bytes(r.data), r.block_starts).tolist() == encode(text[r.doc_id]) for r in rows)
