import pytest

import corpus_pipeline as P
from linescan.llm import decontaminate, mixing, ngram_join, quality, tokens
from linescan.llm._spark import read, tokenizer_file
from tests.llm.cases import words
from tests.llm.test_ngram_join import brute as groups_of


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """What goes into each stage, and what comes out at the end."""
    docs, kept = read(spark, small, "documents"), []
    for k, (_, stage) in enumerate(P.STAGES):
        kept.append(docs)
        at = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, small).write.parquet(at)
        docs = spark.read.parquet(at)
    return [*kept, docs]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(df.columns == stages[0].columns and df.dtypes == stages[0].dtypes for df in stages[:-1])
    assert all(set(ids(b)) <= set(ids(a)) for a, b in zip(stages, stages[1:]))
    assert 4 <= len(P.STAGES) <= 5


def test_quality_stage(spark, small, stages):
    want = quality.kept(stages[0], read(spark, small, "labels"))
    assert ids(stages[1]) == ids(want)


def test_copies_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    drop = {i for g in groups_of(rows, ngram_join.N, ngram_join.THRESHOLD) for i in g[1:]}
    assert ids(stages[2]) == sorted(i for i, _ in rows if i not in drop)


def test_benchmark_stage(spark, small, stages):
    def near(w, v):
        for gap in range(-len(v), len(w)):
            hits = [
                p for p in range(max(0, -gap), min(len(v), len(w) - gap) - decontaminate.SPAN + 1)
                if any(all(v[p + q] == w[p + gap + q] for q in m) for m in decontaminate.MASKS)
            ]
            if hits:
                a, z = hits[0], hits[-1] + decontaminate.SPAN
                if z - a >= decontaminate.MIN_WORDS and sum(v[t] == w[t + gap] for t in range(a, z)) >= decontaminate.MIN_SHARE * (z - a):
                    return True
        return False

    items = [words(r.text) for r in read(spark, small, "benchmark").collect()]
    rows = [(r.doc_id, words(r.text)) for r in stages[2].collect()]
    some = {x for v in items for x in zip(v, v[1:], strict=False)}
    want = [i for i, w in rows if not (some & set(zip(w, w[1:], strict=False)) and any(near(w, v) for v in items))]
    assert ids(stages[3]) == sorted(want)


def test_mixing_stage(stages):
    """Every source has its tempered share, or the most that fits, of a budget of LEAST of the tokens at least."""
    encode = tokens.encoding(tokenizer_file(tokens.VOCABULARY)).encode_ordinary
    size = {r.doc_id: (r.source, len(encode(r.text))) for r in stages[3].collect()}
    total: dict[str, int] = {}
    left: dict[str, int] = {}
    for s, n in size.values():
        total[s] = total.get(s, 0) + n
    for i in ids(stages[4]):
        left[size[i][0]] = left.get(size[i][0], 0) + size[i][1]
    scale = min(n / n**0.7 for n in total.values())
    rest, weight = mixing.LEAST * sum(total.values()), sum(n**0.7 for n in total.values())
    for n in sorted(total.values()):  # sources that fall short are used whole, from the scarcest on
        if n > n**0.7 * rest / weight:
            break
        rest, weight = rest - n, weight - n**0.7
    scale = max(scale, rest / weight) if weight > 1e-6 else scale
    for s, n in total.items():
        reachable, budget = 1, int(n**0.7 * scale + 1e-6)  # the sums of some documents, as bits
        for source, size_ in size.values():
            reachable |= reachable << size_ if source == s else 0
        assert left.get(s, 0) == (reachable & ((1 << budget + 1) - 1)).bit_length() - 1


def test_token_stage(stages):
    encode = tokens.encoding(tokenizer_file(tokens.VOCABULARY)).encode_ordinary
    text = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert ids(stages[5]) == sorted(text)
    assert all(tokens.unpack(bytes(r.data), r.block_starts).tolist() == encode(text[r.doc_id]) for r in rows)


def test_run_is_the_stages_in_turn(spark, small, stages):
    assert sorted(map(tuple, P.run(spark, small).select("doc_id", "n_tokens").collect())) == sorted(map(tuple, stages[5].select("doc_id", "n_tokens").collect()))


def test_empty_and_awkward_documents(spark, small):
    docs = read(spark, small, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, None), (-2, "x", "en", None, 1), (-2, "x", "en", None, 1)], docs.schema)
    for df in (docs.limit(0), docs.limit(50).unionAll(odd)):
        for _, stage in P.STAGES:
            df = spark.createDataFrame(stage(spark, df, small).collect(), stage(spark, df, small).schema)
        assert df.columns == ["doc_id", "n_tokens", "block_starts", "data"]
