import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codewhiff.llm import wavelet as W
from helpers import table


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400))
def test_queries_against_the_plain_array(ids):
    x = np.array(ids, dtype=np.uint16)
    f = W.WaveletFile(W.build(x, [(1, 0, len(x))], 9))
    assert f.access(np.arange(len(x))).tolist() == ids
    for token in {0, 300, 511, *ids[:5]}:
        places = [i for i, v in enumerate(ids) if v == token]
        assert f.occurrences(token).tolist() == places
        assert f.count(token) == len(places)
        for i in (0, len(ids) // 2, len(ids)):
            assert f.rank(token, i) == ids[:i].count(token)
        for k, place in enumerate(places[:3]):
            assert f.select(token, k) == place
        with pytest.raises(IndexError):
            f.select(token, len(places))
    assert f.document(1).tolist() == ids
    assert f.count(-1) == f.count(512) == 0 and f.occurrences(9999).tolist() == []


def test_many_blocks(monkeypatch):
    monkeypatch.setattr(W, "BLOCK_WORDS", 4)
    r = np.random.default_rng(1)
    x = r.integers(0, 50_000, 5000).astype(np.uint16)
    x[::7] = 123
    f = W.WaveletFile(W.build(x, [], 16))
    assert (f.access(np.arange(5000)) == x).all()
    assert (f.occurrences(123) == np.flatnonzero(x == 123)).all()
    assert f.count(123, 100, 3000) == int((x[100:3000] == 123).sum())


@pytest.mark.parametrize("shard_tokens", [1 << 24, 40])
def test_exact_round_trip(spark, shard_tokens):
    texts = [(1, "Hello world, hello!"), (2, None), (3, ""), (None, "naïve café — 東京 🙂"), (4, "the cat " * 30), (4, "the cat " * 30), (5, "<|endoftext|> \n\t x" * 3), (6, "long text of words " * 20_000)]
    df = table(spark, texts, clash=True)
    out = W.write_wavelet_shards(df, shard_tokens=shard_tokens).persist()
    rows = out.collect()
    codec = W.encoder(W.TOKENIZER)
    files = {r.file: W.open_shard(r.file) for r in rows}
    assert len(rows) == len(texts)
    got = []
    for r in rows:
        ids = files[r.file].access(np.arange(r.start, r.start + r.n_tokens)) if r.n_tokens else []
        got.append((r.doc_id, codec.decode(list(map(int, ids)))))
    assert sorted(got, key=str) == sorted([(i, t or "") for i, t in texts], key=str)
    for f in files.values():
        assert sum(n for _, _, n in f.docs) == f.n
    assert any(not f.endswith("-0000.wm") for f in files) == (shard_tokens == 40)  # small shards: a task writes several
    assert W.write_wavelet_shards(table(spark, [])).collect() == []


def test_tokens_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    codec = W.encoder(W.TOKENIZER)
    files = {}
    for r in W.write_wavelet_shards(docs).collect():
        f = files.setdefault(r.file, None) or W.open_shard(r.file)
        files[r.file] = f
        assert codec.decode(f.access(np.arange(r.start, r.start + r.n_tokens)).tolist() if r.n_tokens else []) == (want.pop(r.doc_id) or "")
    assert not want
